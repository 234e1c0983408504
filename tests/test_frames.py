from tallyframe.sources import frames


def opened(at):
    class Numbered:
        def __init__(self, k):
            self.k = k

        def next_frame(self):
            if self.k >= 40:
                raise StopIteration
            self.k += 1
            return b"frame %d" % (self.k - 1)

    return Numbered(at)


def test_frames_of_a_device(spark, tmp_path):
    stream = frames.frame_stream(spark, opened, batch=7)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.seq, bytes(r.payload)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(k, b"frame %d" % k) for k in range(len(got))] and got
    assert [list(frames.FrameReader(opened, 7).readBetweenOffsets({"taken": 38}, {"taken": 45}))] == [[(38, b"frame 38"), (39, b"frame 39")]]
