"""Cases without a common member: a few large ones found by search, then each size's quota filled greedily in order of rank.

Candidates stay in Spark. They are reduced to one of each member set (of equal ones only the first can ever be chosen), and the search
asks for the next block of a bucket in order of rank when it has used up the ones it knows, so only blocks it needs reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.storage import stored

#: Candidates of a bucket that the search gets at once.
BLOCK = 256


@dataclass
class Ranked:
    """A bucket's candidates in order of (rank, case_id), fetched block by block."""

    candidates: DataFrame
    bucket: str
    block: int = BLOCK
    known: list[tuple[str, str, frozenset]] = field(default_factory=list)
    over: bool = False

    def __iter__(self) -> Iterator[tuple[str, frozenset]]:
        at = 0
        while self._has(at):
            yield self.known[at][1:]
            at += 1

    def after(self, at: int) -> Iterator[tuple[int, str, frozenset]]:
        while self._has(at):
            yield at, *self.known[at][1:]
            at += 1

    def _has(self, at: int) -> bool:
        if at >= len(self.known) and not self.over:
            rows = self.candidates.where(F.col("bucket") == self.bucket)
            if self.known:
                last = self.known[-1]
                rows = rows.where(F.struct("rank", "case_id") > F.struct(F.lit(last[0]).alias("rank"), F.lit(last[1]).alias("case_id")))
            found = rows.orderBy("rank", "case_id").limit(self.block).collect()
            self.known += [(r["rank"], r["case_id"], frozenset(r["members"])) for r in found]
            self.over = len(found) < self.block
        return at < len(self.known)


def _disjoint(ranked: Ranked, count: int, used: frozenset, begin: int = 0) -> Iterator[tuple[list[str], frozenset]]:
    """Ways to choose `count` candidates without a common member, in order of their ranks."""
    if not count:
        yield [], used
        return
    for at, case, members in ranked.after(begin):
        if not members & used:
            for more, held in _disjoint(ranked, count - 1, used | members, at + 1):
                yield [case, *more], held


def _filled(buckets: dict[str, Ranked], quotas: dict[str, int], used: frozenset) -> dict[str, list[str]] | None:
    """The first free candidates of each bucket in turn; None if one can't be filled."""
    chosen: dict[str, list[str]] = {}
    for bucket, quota in quotas.items():
        own: list[str] = []
        for case, members in buckets[bucket]:
            if len(own) == quota:
                break
            if not members & used:
                own.append(case)
                used = used | members
        if len(own) < quota:
            return None
        chosen[bucket] = own
    return chosen


def disjoint_cases(candidates: DataFrame, together: tuple[str, int], quotas: dict[str, int], block: int = BLOCK) -> DataFrame:
    """bucket, place, case_id of cases that share no member.

    candidates: case_id, bucket, rank (texts), members (array). The first combination, in order of ranks, of together[1] candidates of
    bucket together[0] is taken for which every quota can be filled greedily, bucket by bucket in the order given. Ties of rank go by
    case_id. Null or empty members make no candidate. Without any such combination a ValueError says so.
    """
    rows = candidates.where(F.size("members") > 0).withColumn("members", F.array_sort(F.array_distinct("members")))
    rows = rows.groupBy("bucket", "members").agg(F.min(F.struct("rank", "case_id")).alias("first")).select("bucket", "first.rank", "first.case_id", F.transform("members", lambda m: m.cast("string")).alias("members"))
    rows = stored(rows, "candidates")
    bucket, count = together
    ranked = {b: Ranked(rows, b, block) for b in {bucket, *quotas}}
    if _filled(ranked, quotas, frozenset()) is not None:  # else no combination can help
        for cases, used in _disjoint(ranked[bucket], count, frozenset()):
            chosen = _filled(ranked, quotas, used)
            if chosen is not None:
                out = [(b, place, case) for b, own in [(bucket, cases), *chosen.items()] for place, case in enumerate(own, 1)]
                return candidates.sparkSession.createDataFrame(out, "bucket string, place long, case_id string")
    raise ValueError("no allocation without common members fills the quotas")
