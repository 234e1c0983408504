"""Mixing sources to target weights.

Temperature mixing: a source with share p of all tokens gets the weight p**a / sum(p**a). The exponent is the largest in
[0, 1] whose weights reach a target entropy (a part of the largest possible), raised again if a source would then be
repeated more often than a limit. It is found by bisection, four halvings a round, each round one small aggregation
over the sources. A source's budget of tokens is spent on whole permutations of its documents, epochs, and one that
breaks off within the budget. A permutation deals documents by hash to blocks and orders each block by hash; counts of
blocks give positions and running tokens, so no task holds a source. A block made large by one id is dealt out by a hash of the texts, and
rows of equal id, source and text are one row with a count until they have their positions, so the result
depends on what the rows hold, not on how files or tasks cut them.

Tokens are runs of other than white space. Cases: a null text has no tokens, a null source is the source "\\N". A source without
tokens has no weight and is not drawn. A document goes in if the budget holds all of it. Rows that repeat an id count
on their own. A very long text is one row whose tokens are counted where it is read. An empty table gives an empty result. Only id, source and
text are read, and mixed() nests the input's columns, so their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import bounded, cut, nested, one_by_one, table

#: Documents that are ordered together; a block of over four times as many is dealt out.
BLOCK_DOCS = 2_000
#: Rounds of bisection, of four halvings each, and the decimals of the exponent.
ROUNDS, STEPS, DECIMALS = 10, 16, 9
WORD = r"[^\x20\x09-\x0D]+"


def _exponent(shares: DataFrame, entropy: float | None, repeats: float | None, ratio: float | None) -> float:
    """shares: p of each source. ratio: budget by all tokens; None if the budget holds every document at least once."""

    def search(good) -> tuple[float, float]:
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * k / STEPS for k in range(STEPS + 1)]
            power = F.pow("p", "a")
            rows = (
                shares.select("p", F.explode(F.array(*map(F.lit, grid))).alias("a"))
                .groupBy("a")
                .agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("e"), F.max(F.pow("p", F.col("a") - 1)).alias("most"), F.min(F.pow("p", F.col("a") - 1)).alias("least"), F.count("*").alias("n"))
                .orderBy("a")
                .collect()  # STEPS + 1 rows
            )
            k = sum(good(r) for r in rows)
            if k in (0, len(rows)):
                return (low, low) if not k else (high, high)
            low, high = rows[k - 1]["a"], rows[k]["a"]
        return low, high

    import math

    a = 1.0 if entropy is None else search(lambda r: math.log(r["z"]) - r["a"] * r["e"] / r["z"] >= entropy * math.log(r["n"]) - 1e-12)[0]
    if repeats is not None:
        a = max(a if entropy is not None else 0.0, search(lambda r: (r["most"] / r["z"] * ratio if ratio else r["most"] / r["least"]) > repeats)[1])
    return round(a, DECIMALS)


def weights(base: DataFrame, entropy: float | None, repeats: float | None, budget: int | str | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per source with tokens: source, n (its tokens), weight, budget, epochs (whole ones), rest (tokens), blocks.

    base: (source, tokens, rows: how many such rows there are). budget: tokens in all; None for as many as there are, "cover" for as few as hold every document.
    """
    per = cut(base.groupBy("source").agg(F.sum(F.col("tokens") * F.col("rows")).alias("n"), F.sum("rows").alias("docs")).where("n > 0"))
    total = per.agg(F.sum("n")).first()[0] or 0
    shares = per.withColumn("p", F.col("n") / F.lit(float(max(total, 1))))
    a = _exponent(shares.select("p"), entropy, repeats, None if budget == "cover" else (budget or total) / max(total, 1)) if total else 1.0
    power = F.pow("p", F.lit(a))
    z, least = shares.agg(F.sum(power), F.min(F.pow("p", F.lit(a - 1)))).first()
    if budget == "cover":
        spent = F.lit(total * z / least if total else 0.0)
    else:
        spent = F.lit(float(budget or total))
    return (
        shares.withColumn("weight", power / F.lit(z or 1.0))
        .withColumn("budget", F.greatest(F.col("n"), F.round(spent * F.col("weight")).cast("long")) if budget == "cover" else F.round(spent * F.col("weight")).cast("long"))
        .withColumn("epochs", F.expr("budget div n"))
        .withColumn("rest", F.col("budget") % F.col("n"))
        .withColumn("blocks", F.ceil(F.col("docs") / block_docs))
        .select("source", "n", "weight", "budget", "epochs", "rest", "blocks")
    )


def _hash(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("\\N"))))


def draws(docs: DataFrame, entropy: float | None = 0.98, repeats: float | None = 4, budget: int | str | None = None, seed: int = 1, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row for each time that a document is drawn: doc_id, source, tokens, weight, epoch, position (gapless from 0 in the
    source's epoch) and progress (the part of the source's budget that is spent before it)."""
    read = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("\\N")).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"), F.xxhash64(text_col).alias("text")
    )
    base = cut(read.groupBy("doc_id", "source", "tokens", "text").agg(F.count("*").alias("rows")))
    per = cut(weights(base, entropy, repeats, budget, block_docs))
    copies = (
        base.join(bounded(per), "source")
        .withColumn("epoch", F.explode(F.expr("sequence(0L, epochs - if(rest = 0, 1L, 0L))")))
        .where("epoch >= 0")
        .withColumn("hash", _hash(seed))
        .withColumn("block", F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") % F.col("blocks"))
    )
    key = ["source", "epoch", "block"]
    sized = copies.groupBy(*key).agg(F.sum("rows").alias("count"))
    large = cut(sized.where(F.col("count") > 4 * block_docs).select(*key, F.ceil(F.col("count") / block_docs).alias("parts")))
    dealt = copies.join(bounded(large), key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "text"), "parts"), F.lit(0)))
    key = [*key, "part"]
    before = Window.partitionBy("source", "epoch").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    cost = F.col("tokens") * F.col("rows")
    sums = dealt.groupBy(*key).agg(F.sum("rows").alias("_rows"), F.sum(cost).alias("_tokens"))
    starts = cut(sums.select(*key, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("row_start"), F.coalesce(F.sum("_tokens").over(before), F.lit(0)).alias("token_start")))
    inside = Window.partitionBy(*key).orderBy("hash", "doc_id", "tokens", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(bounded(starts), key).select(
        "doc_id", "source", "tokens", "weight", "epoch", "n", "budget", "epochs", "rest", "rows",
        (F.col("row_start") + F.sum("rows").over(inside) - F.col("rows")).alias("position"),
        (F.col("token_start") + F.sum(cost).over(inside) - cost).alias("spent"),
    )
    each = one_by_one(placed).withColumn("position", F.col("position") + F.col("k")).withColumn("spent", F.col("spent") + F.col("k") * F.col("tokens"))
    return each.where("epoch < epochs or spent + tokens <= rest").select(
        "doc_id", "source", "tokens", "weight", F.col("epoch").cast("int").alias("epoch"), "position", ((F.col("epoch") * F.col("n") + F.col("spent")) / F.col("budget")).alias("progress")
    )


def mixed(docs: DataFrame, drawn: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents, each as often as it is drawn. Rows with null ids stay once."""
    times = drawn.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times"))
    rows = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.count("*").alias("rows")).where("rows > 1")
    often = times.join(rows, "doc_id", "left").select("doc_id", F.ceil(F.col("times") / F.coalesce("rows", F.lit(1))).cast("int").alias("times"))
    kept = docs.where(F.col(id_col).isNotNull()).select(nested(docs), F.col(id_col).alias("doc_id")).join(often, "doc_id")
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*").unionByName(docs.where(F.col(id_col).isNull()))


#: Production parameters of the query.
ENTROPY, REPEATS, SEED = 0.98, 4.0, 1


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = draws(table(spark, sf_dir, "documents"), ENTROPY, REPEATS, seed=SEED)
    return found.select("doc_id", "source", "tokens", F.round("weight", 6).alias("weight"), "epoch", "position", F.round("progress", 6).alias("progress"))


def sql(entropy: float = ENTROPY, repeats: float = REPEATS, seed: int = SEED, block_docs: int = BLOCK_DOCS) -> str:
    """What op1 returns, for tables without a block over four times block_docs."""
    return f"""
with recursive base as (
  select doc_id, coalesce(source, '\\N') as source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as tokens from documents),
per as (select source, sum(tokens)::bigint as n, count(*) as docs from base group by source having sum(tokens) > 0),
shares as (select *, n / (select sum(n) from per)::double as p from per),
bits(step, mode, low, high) as (
  select 0, mode, 0.0::double, 1.0::double from (values ('entropy'), ('repeats')) m(mode)
  union all
  select step + 1, mode, case when ok then mid else low end, case when ok then high else mid end from (
    select *, case when mode = 'entropy'
      then (select ln(sum(p ** mid)) - mid * sum(p ** mid * ln(p)) / sum(p ** mid) >= {entropy} * ln(count(*)) - 1e-12 from shares)
      else (select max(p ** (mid - 1)) / sum(p ** mid) > {repeats} from shares) end as ok
    from (select *, (low + high) / 2 as mid from bits where step < 44))),
exponent as (
  select round(greatest(
    case when (select -sum(p * ln(p)) >= {entropy} * ln(count(*)) - 1e-12 from shares) then 1.0 else (select low from bits where step = 44 and mode = 'entropy') end,
    case when (select max(1 / p) / count(*) > {repeats} from shares) then (select high from bits where step = 44 and mode = 'repeats') else 0.0 end), {DECIMALS}) as a),
weighed as (select source, n, docs, p ** a / (select sum(p ** a) from shares, exponent) as weight from shares, exponent),
budgets as (select *, round((select sum(n) from per) * weight)::bigint as budget, ceil(docs / {block_docs}.0)::bigint as blocks from weighed),
copies as (
  select doc_id, source, tokens, n, weight, budget, blocks, budget // n as epochs, budget % n as rest, unnest(range(0, budget // n + case when budget % n = 0 then 0 else 1 end)) as epoch
  from base join budgets using (source)),
hashed as (select *, md5(concat_ws(':', {seed}, epoch, doc_id)) as hash from copies),
placed as (
  select *, row_number() over w - 1 as position, sum(tokens) over (w rows between unbounded preceding and current row) - tokens as spent
  from (select *, ('0x' || substr(hash, 1, 8))::bigint % blocks as block from hashed)
  window w as (partition by source, epoch order by block, hash, doc_id, tokens))
select doc_id, source, tokens, round(weight, 6) as weight, epoch::int as epoch, position, round((epoch * n + spent)::double / budget, 6) as progress
from placed where epoch < epochs or spent + tokens <= rest
"""


QUERIES = {"op1_temperature_mixing": op1_temperature_mixing}
SQL = {"op1_temperature_mixing": sql()}
