"""Alignment of chunks with transcript segments, and transcripts cut to minutes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minute_buckets(segments: DataFrame, video: str = "video", start: str = "start", text: str = "text", width: int = 60) -> DataFrame:
    """video, bucket, start_time, end_time, text. A bucket closes with the first segment that starts at or after its mark,
    which it includes; the mark then moves on by one width, so it may lag after a pause; the rest is the last bucket."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([start, text], kind="stable")
        out, held, mark = [], [], width
        for s, x in zip(rows[start], rows[text]):
            held.append((s, x))
            if s >= mark:
                out.append(held)
                held, mark = [], mark + width
        if held:
            out.append(held)
        name = rows[video].iloc[0]
        return pd.DataFrame([(name, k, b[0][0], b[-1][0], " ".join(x for _, x in b)) for k, b in enumerate(out)], columns=[video, "bucket", "start_time", "end_time", "text"])

    kind = segments.schema[video].dataType.simpleString()
    return segments.select(video, F.col(start).cast("long").alias(start), text).groupBy(video).applyInPandas(fold, f"{video} {kind}, bucket int, start_time long, end_time long, text string")


def tumbling_minutes(segments: DataFrame, video: str = "video", start: str = "start", text: str = "text", width: int = 60) -> DataFrame:
    """The usual tumbling windows, in which a segment at a mark opens the next one: one aggregation, no fold."""
    bucket = F.floor(F.col(start) / width).alias("bucket")
    made = segments.groupBy(video, bucket).agg(F.array_sort(F.collect_list(F.struct(start, text))).alias("s"))
    return made.select(video, "bucket", F.array_min(F.transform("s", lambda s: s[start])).alias("start_time"), F.array_max(F.transform("s", lambda s: s[start])).alias("end_time"),
                       F.array_join(F.transform("s", lambda s: s[text]), " ").alias("text"))


def best_segments(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """chunk_id, start_segment, end_segment: the segments most like the first and last words of each chunk (video, chunk_id,
    text) among those of its video (video, segment, text); ties to the earlier one."""
    from veritrail.functions.fuzzy import _over, ratio

    score = _over(ratio)
    words = F.split("text", r"\s+")
    ends = chunks.select("video", "chunk_id", F.array_join(F.slice(words, 1, 8), " ").alias("head"), F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 7), 8), " ").alias("tail"))
    pairs = ends.join(segments.select("video", "segment", F.col("text").alias("seg_text")), "video")
    scored = pairs.select("chunk_id", "segment", score(F.col("head"), F.col("seg_text")).alias("h"), score(F.col("tail"), F.col("seg_text")).alias("t"))
    best = lambda c: F.min(F.struct((-F.col(c)).alias("s"), "segment"))["segment"]
    return scored.groupBy("chunk_id").agg(best("h").alias("start_segment"), best("t").alias("end_segment"))
