"""Secret scans: three fixed patterns, and a pair of character Markov models for what has no fixed form.

Both models are first-order over ASCII characters, one of random strings and one of ordinary identifiers, trained from
labelled samples with additive smoothing. A token is a secret if the log-likelihood ratio of its transitions, in bits
each, reaches a threshold. Everything runs as SQL functions inside one pass over the texts, without a shuffle.

Work grows in proportion to a text's length, whatever is in it: matches are walked once, in steps of STEP (scan), spans and tokens
are merged in order of their start, and a text is rewritten in pieces of PIECE characters.

Cases: a null text is empty and has no spans. Positions count code points, end exclusive. Rows are handled one by one,
so repeated ids and rows stay as they are. The input's columns are nested in one, so their names don't matter. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import nested, table

# The base patterns, with the group that must have a least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
#: What the Markov models look at: runs of so many characters at least.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Elements that a walk gathers at once, so that no long array is copied for each of them; characters of a piece that is rewritten.
STEP, PIECE = 64, 1_000
#: Bits per transition by which the random model must be likelier.
THRESHOLD = 0.9
#: Ordinary words that identifiers are made of, in the languages of the corpus.
WORDS = (
    "get set user name count index value total session request response handler config option default "
    "buffer stream reader writer parse format message content document record table column query result "
    "update delete insert create remove service client server account customer product order invoice number "
    "description management international administration configuration implementation authentication "
    "der die das und nicht einer werden haben zwischen verarbeitung einstellungen benutzer verwaltung gesellschaft "
    "wirtschaft entwicklung bezeichnung rechtsprechung sicherheit freundschaft geschwindigkeit "
    "le la les une dans pour avec utilisateur gestion traitement gouvernement developpement environnement "
    "el los una para con usuario gestion desarrollo administracion informacion responsabilidad naturalmente"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """A struct of state, after step(state, item) for each item in turn, and outs, what step gave for each (of type out).

    An aggregate copies what it has gathered at each step. So a first walk gathers only the state before each STEP items, and a
    second one, which starts from these, gathers what the items give, STEP at a time."""
    none = F.array().cast(f"array<{out}>")

    def one(acc: Column, x: Column) -> Column:
        after, given = step(acc["state"], x)
        return F.struct(after.alias("state"), F.array_append(acc["outs"], given).alias("outs"))

    def several(parts: Column) -> Column:
        states = F.aggregate(parts, F.array(state), lambda known, part: F.array_append(known, F.aggregate(part, F.element_at(known, -1), lambda s, x: step(s, x)[0])))
        gathered = lambda known: F.transform(parts, lambda part, k: F.aggregate(part, F.struct(F.get(known, k).alias("state"), none.alias("outs")), one)["outs"])
        return let(states, lambda known: F.struct(F.element_at(known, -1).alias("state"), F.flatten(gathered(known)).alias("outs")))

    def whole(all_items: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / STEP).cast("int")), lambda k: F.slice(all_items, k * STEP + 1, STEP))
        return F.when(F.size(all_items) > 0, let(parts, several)).otherwise(F.struct(state.alias("state"), none.alias("outs")))

    return let(items, whole)


def _found(text: Column, pattern: str, least: int, group: int = 0) -> Column:
    """Start, end and text of the pattern's matches whose group has the least length. Positions follow from the lengths of the
    matches and of what lies between them."""
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), part.alias("part"))
    kind = "struct<start:int,end:int,hit:string>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        return end, F.when(F.char_length(x["part"]) >= least, F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))

    walked = scan(F.filter(parts, lambda x: x["hit"].isNotNull()), F.lit(0), step, kind)["outs"]
    return F.when(F.regexp_like(text, F.lit(pattern)), F.filter(walked, lambda x: x.isNotNull())).otherwise(F.array().cast(f"array<{kind}>"))


def _apart(tokens: Column, spans: Column) -> Column:
    """The tokens that no span overlaps. Both are laid in order of their start; walked forwards, a token meets spans that began before it and
    still last, and walked backwards, spans that begin before it ends."""
    kind = "struct<start:int,token:boolean,end:int,hit:string>"
    marked = lambda items, token: F.transform(items, lambda x: F.struct(x["start"].alias("start"), F.lit(token).alias("token"), x["end"].alias("end"), (x["hit"] if token else F.lit(None).cast("string")).alias("hit")))
    both = F.sort_array(F.concat(marked(spans, False), marked(tokens, True)))  # a span before a token at the same place
    forwards = lambda last, x: (F.when(x["token"], last).otherwise(F.greatest(last, x["end"])), F.when(~x["token"] | (x["start"] >= last), x))
    backwards = lambda next_, x: (F.when(x["token"], next_).otherwise(x["start"]), F.when(x["token"] & (x["end"] <= next_), x))
    some = F.filter(scan(both, F.lit(0), forwards, kind)["outs"], lambda x: x.isNotNull())
    clear = F.filter(scan(F.reverse(some), F.lit(2**31 - 1), backwards, kind)["outs"], lambda x: x.isNotNull())
    return F.when(F.size(spans) == 0, tokens).otherwise(F.transform(F.reverse(clear), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"))))


def _kind(number: int, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end")))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])))


def samples(spark: SparkSession, prose: DataFrame | None = None, text_col: str = "text", each: int = 3_000) -> DataFrame:
    """(token, random): labelled tokens. Random ones are digests in usual alphabets, ordinary ones are words joined in
    usual ways: those of WORDS, and those of a small table of prose if there is one."""
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id")), 256)
    random = spark.range(each).select(
        F.explode(F.array(F.substring(digest, 1, 40), F.regexp_replace(F.base64(F.unhex(digest)), "=", ""), F.upper(F.concat(F.conv(F.substring(digest, 1, 15), 16, 36), F.conv(F.substring(digest, 16, 15), 16, 36))), F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", ""))).alias("token")
    ).select("token", F.lit(True).alias("random"))
    lines = spark.range(1).select(F.lit(WORDS).alias("t"))
    if prose is not None:
        lines = lines.unionByName(prose.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")))
    words = lines.select(F.split(F.trim(F.regexp_replace("t", "[^A-Za-z]+", " ")), " ").alias("w"))
    three = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.slice("w", i + 1, 3))).alias("w"))
    ordinary = three.select(
        F.explode(F.array(F.lower(F.array_join("w", "_")), F.array_join("w", ""), F.regexp_replace(F.initcap(F.array_join("w", " ")), " ", ""), F.array_join("w", "-"), F.upper(F.array_join("w", "_")), F.array_join("w", "/"), F.concat(F.lower(F.array_join("w", "_")), F.length(F.array_join("w", ""))))).alias("token")
    ).select("token", F.lit(False).alias("random"))
    return random.unionByName(ordinary).where(F.char_length("token") > 1)


def train(labelled: DataFrame, smoothing: float = 0.5) -> list[float]:
    """The ratio in bits for each transition, at 128 * previous + next character. The driver gets at most 2 * 128 * 128 counts."""
    chars = F.split("token", "")
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("token") - 1), lambda i: F.struct(F.ascii(F.element_at(chars, i)).alias("a"), F.ascii(F.element_at(chars, i + 1)).alias("b")))
    rows = labelled.where(F.char_length("token") > 1).select("random", F.explode(pairs).alias("p")).where("p.a < 128 and p.b < 128").groupBy("random", "p.a", "p.b").count().collect()
    seen = {(r["random"], r["a"], r["b"]): r["count"] for r in rows}
    total: dict = {}
    for (random, a, _), n in seen.items():
        total[random, a] = total.get((random, a), 0) + n
    symbols = 66
    p = lambda random, a, b: (seen.get((random, a, b), 0) + smoothing) / (total.get((random, a), 0) + symbols * smoothing)
    return [round(math.log2(p(True, a, b) / p(False, a, b)), 4) for a in range(128) for b in range(128)]


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions; 0 for a single character. Tokens are ASCII."""
    bits = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # a constant
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    walk = F.aggregate(
        F.split(token, ""),
        start,
        lambda acc, c: F.struct(F.ascii(c).alias("last"), (acc["sum"] + F.when((acc["last"] < 0) | (F.ascii(c) > 127), 0.0).otherwise(F.element_at(bits, F.greatest(acc["last"], F.lit(0)) * 128 + F.ascii(c) + 1))).alias("sum")),
    )
    return walk["sum"] / F.greatest(F.char_length(token) - 1, F.lit(1))


def scan_texts(docs: DataFrame, model: list[float], text_col: str = "text", threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """row (all columns of docs), base and spans (sorted arrays of (start, kind, end): the spans of fixed form, and all spans)
    and hidden (the text with a mark in place of what spans cover)."""

    def spotted(text: Column) -> Column:
        return F.sort_array(F.concat(_kind(0, _found(text, ASSIGN, 12, 2)), _kind(1, _found(text, ACCESS, 18)), _kind(2, _found(text, HEX.replace("+", "{16,}"), 16))))

    def judged(text: Column, base: Column) -> Column:
        likely = F.filter(let(_found(text, TOKEN, 1), lambda tokens: F.when(F.size(tokens) > 0, _apart(tokens, base)).otherwise(tokens)), lambda x: ratio(x["hit"], model) >= threshold)
        return F.sort_array(F.concat(base, _kind(3, likely)))

    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(nested(docs))
    found = rows.select("row", let(text, lambda t: let(spotted(t), lambda base: F.struct(base.alias("base"), judged(t, base).alias("spans")))).alias("found"))
    return found.select("row", "found.base", "found.spans", redact(text, F.col("found.spans"), mark).alias("hidden"))


def merged(spans: Column) -> Column:
    """Sorted spans without overlap; those that only touch stay apart."""
    kind = "struct<start:int,end:int>"
    span = lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))

    def step(open_: Column, x: Column) -> tuple[Column, Column]:
        joins = x["start"] < open_["end"]
        return F.when(joins, F.struct(open_["start"].alias("start"), F.greatest(open_["end"], x["end"].cast("int")).alias("end"))).otherwise(span(x)), F.when(~joins & (open_["end"] >= 0), open_)

    walked = scan(spans, F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end")), step, kind)
    return let(walked, lambda w: F.filter(F.array_append(w["outs"], w["state"]), lambda x: x["end"] >= 0))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with what the sorted spans cover replaced; overlapping spans are replaced once. Each piece takes the spans that reach into it from where the one before
    it stopped."""

    def piece(cover: Column) -> Callable[[Column, Column], tuple[Column, Column]]:
        def step(state: Column, own: Column) -> tuple[Column, Column]:
            a, b = state["at"], state["at"] + F.char_length(own)
            ahead = F.slice(cover, state["next"], PIECE + 2)

            def rewritten(some: Column) -> Column:
                def part(k: Column) -> Column:
                    since = F.when(k == 0, a).otherwise(F.greatest(a, F.get(some, k - 1)["end"]))
                    until = F.when(k < F.size(some), F.get(some, k)["start"]).otherwise(b)
                    here = F.when((k < F.size(some)) & (F.get(some, k)["start"] >= a), F.lit(mark)).otherwise(F.lit(""))
                    return F.concat(F.when(until > since, own.substr(since - a + 1, until - since)).otherwise(F.lit("")), here)

                return F.when(F.size(some) == 0, own).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.size(some)), part), ""))

            passed = F.size(F.filter(ahead, lambda x: x["end"] <= b))
            return F.struct(b.alias("at"), (state["next"] + passed).alias("next")), let(F.filter(ahead, lambda x: x["start"] < b), rewritten)

        return step

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    walked = let(merged(spans), lambda cover: F.array_join(scan(pieces, F.struct(F.lit(0).alias("at"), F.lit(1).alias("next")), piece(cover), "string")["outs"], ""))
    return F.when(F.size(spans) == 0, text).otherwise(walked)


def default_model(spark: SparkSession, sf_dir: str) -> list[float]:
    return train(samples(spark, table(spark, sf_dir, "benchmark")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), default_model(spark, sf_dir)).select("row.doc_id", "base", "spans")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op2_secret_scan": op2_secret_scan}
#: None: trained models have no counterpart in SQL. tests/llm/test_secrets.py has a plain version.
SQL: dict[str, str] = {}
