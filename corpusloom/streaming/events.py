"""Generation events: folding deltas into messages, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "cancelled", "error")
KEYS = ["session_id", "request_id"]
RECORD = "error string, message struct<role:string,content:string>, done boolean, prompt_eval_count int, eval_count int, total_duration long, bad string"


def read_model_records(lines: DataFrame) -> DataFrame:
    """Text lines of model output -> records; blank lines are skipped and malformed ones marked."""
    read = F.from_json("value", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    rows = lines.where(F.trim("value") != "").withColumn("r", read)
    failed = F.when(F.col("r.bad").isNotNull(), "malformed_record").when(F.col("r.error").isNotNull(), "model_error").when(F.col("r.message").isNull() & ~F.coalesce("r.done", F.lit(False)), "malformed_record")
    return rows.select(*[c for c in lines.columns if c != "value"], "r.*", failed.alias("failure")).drop("bad")


def read_model_stream(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Model output from a folder of NDJSON files, one a request named ``<session>__<request>.ndjson``: session_id, request_id, seq (line from 0) and the record.

    A file is read whole, as one answer, so that its lines keep their order; in a stream
    each file is one that has been moved in complete.
    """
    reader = (spark.readStream.schema("value string") if streaming else spark.read).format("text").option("wholetext", True).option("pathGlobFilter", "*.ndjson")
    name = F.split(F.regexp_extract("file", r"([^/]+)\.ndjson$", 1), "__")
    files = reader.load(path).select("value", F.col("_metadata.file_path").alias("file"))
    lines = files.select(F.get(name, F.lit(0)).alias("session_id"), F.get(name, F.lit(1)).alias("request_id"), F.posexplode(F.split("value", "\n")).alias("seq", "value"))
    return read_model_records(lines)


def write_usage_stream(records: DataFrame, path: str, checkpoint: str):
    """Starts the fold of a stream of ``read_model_stream`` into ``path``; each micro-batch has a folder of its own, written anew if it is replayed."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        stream_usage(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """The usage of each request, from its latest batch."""
    rows = spark.read.parquet(path)
    nth = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("batch")))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth", "batch")


def stream_usage(records: DataFrame) -> DataFrame:
    """By request: text, whether it ended, and token counts; records after the first done one do not count."""
    done = records.where("done").groupBy(*KEYS).agg(F.min("seq").alias("last"))
    kept = records.join(done, KEYS, "left").where("last IS NULL OR seq <= last")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("message.content", F.lit("")).alias("t")))), lambda x: x["t"]), "")
    end = F.max_by(F.struct("prompt_eval_count", "eval_count", (F.col("total_duration") / 1e6).alias("total_ms")), "seq")
    out = kept.groupBy(*KEYS).agg(text.alias("content"), F.max("last").alias("last"), end.alias("usage"))
    return out.select(*KEYS, "content", F.when(F.col("last").isNull(), "missing_done").alias("failure"), F.when(F.col("last").isNotNull(), F.col("usage")).alias("usage"))


def dedupe_requests(commands: DataFrame) -> DataFrame:
    """The first command of each request."""
    order = Window.partitionBy(*KEYS).orderBy("event_ts", "seq")
    return commands.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def terminal_wins(events: DataFrame) -> DataFrame:
    """Events up to and with the first terminal one of their request."""
    first = events.where(F.col("type").isin(*TERMINAL)).groupBy(*KEYS).agg(F.min("seq").alias("end"))
    return events.join(first, KEYS, "left").where("end IS NULL OR seq <= end").drop("end")


def fold_deltas(events: DataFrame, require_accepted: bool = False) -> DataFrame:
    """By request: content of its deltas in order, status, and number of deltas."""
    kept = terminal_wins(events)
    if require_accepted:
        since = kept.where("type = 'accepted'").groupBy(*KEYS).agg(F.min("seq").alias("since"))
        kept = kept.join(since, KEYS, "left").where("type <> 'delta' OR seq > since").drop("since")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "delta", F.struct("seq", "content")))), lambda x: x["content"]), "")
    end = F.max(F.when(F.col("type").isin(*TERMINAL), F.col("type")))
    begun = F.count_if(F.col("type") == "delta")
    status = F.when(end == "error", "failed").when(end.isNotNull(), end).when(begun > 0, "streaming").otherwise("pending")
    return kept.groupBy(*KEYS).agg(text.alias("content"), status.alias("status"), begun.alias("deltas"))


def fold_deltas_stream(events: DataFrame, timeout: str = "330 seconds") -> DataFrame:
    """The same as a stream over ``events(session_id, request_id, seq, event_ts, type, content)``: a row when a request ends, or is silent for ``timeout``.

    The state keeps a list of deltas and joins it once, at the end. That of an ended or
    stalled request stays, empty, until the watermark has passed its last event by
    ``timeout``, so that a late delta starts no second row, and is then removed.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    limit = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts, status, last = state.get if state.exists else ([], "pending", 0)
        parts, ended = list(parts), status in ("completed", "cancelled", "failed", "stalled")
        if state.hasTimedOut and ended:
            state.remove()
            return
        if state.hasTimedOut:
            yield pd.DataFrame({"session_id": [key[0]], "request_id": [key[1]], "content": ["".join(c for _, c in sorted(map(tuple, parts)))], "status": ["stalled"], "deltas": [len(parts)]})
            state.update(([], "stalled", state.getCurrentWatermarkMs()))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + limit)
            return
        for pdf in batches:
            for r in pdf.sort_values("seq").itertuples():
                last = max(last, int(r.event_ts.timestamp() * 1000))
                if ended:
                    continue
                if r.type == "delta":
                    parts.append((int(r.seq), r.content))
                    status = "streaming"
                elif r.type in TERMINAL:
                    status, ended = ("failed" if r.type == "error" else r.type), True
                    yield pd.DataFrame({"session_id": [key[0]], "request_id": [key[1]], "content": ["".join(c for _, c in sorted(parts))], "status": [status], "deltas": [len(parts)]})
        state.update(([] if ended else parts, status, last))
        state.setTimeoutTimestamp(max(last + limit, state.getCurrentWatermarkMs() + 1))

    return (
        events.withWatermark("event_ts", "10 minutes")
        .groupBy(*KEYS)
        .applyInPandasWithState(fold, "session_id string, request_id string, content string, status string, deltas long", "parts array<struct<seq:long,content:string>>, status string, last long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def detect_stalled(events: DataFrame, gap_seconds: int = 330) -> DataFrame:
    """Requests with a silence longer than the gap before their next event, or an open end before the newest event of all."""
    order = Window.partitionBy(*KEYS).orderBy("seq")
    newest = events.select(F.max("event_ts")).scalar()
    kept = terminal_wins(events).withColumn("next_ts", F.coalesce(F.lead("event_ts").over(order), newest))
    silent = F.unix_micros("next_ts") - F.unix_micros("event_ts") > gap_seconds * 1_000_000
    return kept.where(~F.col("type").isin(*TERMINAL) & silent).groupBy(*KEYS).agg(F.min("event_ts").alias("stalled_after"))


def admit_one_active(requests: DataFrame) -> DataFrame:
    """``requests(session_id, request_id, start_ts, end_ts)``: one that starts before all admitted before it have ended is session_busy.

    The rule depends on earlier verdicts, so each session is walked in order of start.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_ts", "request_id"])
        free, out = None, []
        for r in pdf.itertuples():
            admitted = free is None or r.start_ts >= free
            out.append("admitted" if admitted else "session_busy")
            if admitted:
                free = r.end_ts
        return pdf.assign(decision=out)

    return requests.groupBy("session_id").applyInPandas(walk, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema) + ", decision string")


def generation_metrics(usage: DataFrame, *by: str) -> DataFrame:
    """Requests, tokens in and out and times in milliseconds by status, and by any columns of ``by`` before it.

    ``usage(status, prompt_tokens, completion_tokens, total_ns)`` has a row a request;
    requests without a time count in ``requests`` only.
    """
    ms = F.col("total_ns") / 1e6
    return usage.groupBy(*by, "status").agg(
        F.count("*").alias("requests"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms"), F.percentile_approx(ms, 0.5).alias("median_ms"), F.percentile_approx(ms, 0.95).alias("p95_ms"),
    )


def read_event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("session_id string, request_id string, seq long, event_ts timestamp, type string, content string").json(path)
