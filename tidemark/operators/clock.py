"""Hybrid logical clock stamps: milliseconds, a counter, and the client, ordered in that order."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

Stamp = tuple[int, int, str]
STAMP_TYPE = "struct<ms:bigint,logical:int,client:string>"


@dataclass
class HybridClock:
    """Each stamp is above all that this clock gave or has seen, whatever the wall clock does."""

    client: str
    last: Stamp = field(default=(0, 0, ""))
    now: object = staticmethod(lambda: int(time.time() * 1000))

    def next(self) -> Stamp:
        ms = self.now()
        self.last = (ms, 0, self.client) if ms > self.last[0] else (self.last[0], self.last[1] + 1, self.client)
        return self.last

    def observe(self, stamp: Stamp) -> None:
        if tuple(stamp) > self.last:
            self.last = tuple(stamp)


def stamp_column(stamp: Stamp) -> Column:
    return F.struct(F.lit(stamp[0]).cast("long").alias("ms"), F.lit(stamp[1]).alias("logical"), F.lit(stamp[2]).alias("client"))
