"""Live input with the engine's own loop-back: what a batch emits comes in again behind the guards, until a drain adds nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import ingest
from tidemark.sources import streams
from tidemark.streaming import topics


def union_streams(live: DataFrame, loop: DataFrame) -> DataFrame:
    """Live input with the loop-back, without what the lake emitted and without evaluations that scores caused."""
    return ingest.drop_score_evals(ingest.drop_origin(live.unionByName(loop)))


def run_to_fixed_point(spark: SparkSession, live: topics.Topic, step: Callable[[DataFrame], DataFrame], name: str, most: int = 1_000) -> DataFrame:
    """Drain ``step`` over live and loop-back until it emits nothing; returns all it emitted (rows of the live topic's schema).

    The output folder is the loop-back topic: a drain reads what the drains before have written. Offsets and state live in one checkpoint, so a
    run that was stopped goes on where it was. Batches are written under their ids, so a retry replaces itself. More than ``most``
    drains are an error, for then the guards let the loop feed itself.
    """
    out, checkpoint = topics.new_folder(spark, f"{name}-loop"), topics.new_folder(spark, f"{name}-checkpoint")
    spark.createDataFrame([], live.schema).write.parquet(f"{out}/batch=-1")
    loop = spark.read.schema(live.schema).option("recursiveFileLookup", "true")
    before = -1
    for _ in range(most):
        back = spark.readStream.schema(live.schema).option("recursiveFileLookup", "true").parquet(out)
        both = union_streams(streams.read_files(spark, live.path, live.schema), back)
        with topics.rocksdb(spark):
            streams.run_available_now(step(both), checkpoint, streams.idempotent_batch(spark, out, streams.overwrite_parquet))
        now = loop.parquet(out).count()
        if now == before or now == 0:
            return loop.parquet(out)
        before = now
    raise RuntimeError(f"{name} still emits after {most} drains")


EVENT = "entityId string, kind string, step int, ts long, headers array<struct<key string, value string>>"


class MilestoneChain(StatefulProcessor):
    """Keyed by member: completions, milestones that were emitted, and those that have come back as input.

    Milestone k needs completion k and, but for the first, that milestone k - 1 has come back. It is emitted once, at the later of
    their times; a score goes with it, as after every evaluation.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done, self.back, self.emitted = (handle.getMapState(n, "step int", "ts long") for n in ("done", "back", "emitted"))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        out = []
        for e in sorted(rows, key=lambda e: (e.ts, e.kind, e.step)):
            known = self.done if e.kind == "completion" else self.back
            if not known.containsKey((e.step,)):
                known.updateValue((e.step,), (e.ts,))
            k = e.step + (e.kind == "milestone")
            ready = self.done.containsKey((k,)) and (k == 0 or self.back.containsKey((k - 1,))) and not self.emitted.containsKey((k,))
            if ready:
                at = max(self.done.getValue((k,))[0], self.back.getValue((k - 1,))[0] if k else 0)
                self.emitted.updateValue((k,), (at,))
                out += [Row(entityId=key[0], kind=kind, step=k, ts=at, headers=[Row(key="type", value=why)]) for kind, why in (("milestone", "eligibility"), ("score", "score"))]
        return iter(out)

    def close(self) -> None:
        pass


def milestone_chain(events: DataFrame) -> DataFrame:
    """The milestones and scores (``EVENT``) that completions and milestones of a stream bring about; incomplete and other events do not count."""
    whole = events.where("kind IN ('completion', 'milestone') AND entityId IS NOT NULL AND step IS NOT NULL AND ts IS NOT NULL")
    return whole.select("entityId", "kind", "step", "ts").groupBy("entityId").transformWithState(MilestoneChain(), EVENT, "append", "None")
