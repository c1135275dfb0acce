"""The writers' loop as a stream: a new question is taken only if it is no near duplicate of one taken before it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class TakenQuestions(StatefulProcessor):
    """The state of a group: the words of each taken question by its place, and for each word the places that it leads to.

    Two sets of words at the threshold share one of their first ``n - ceil(threshold * n) + 1`` words in the order of the alphabet (n
    their own size), so only these lead to a question and only these are looked up. A new question reads the few
    questions that they lead to, not all that its group has.
    """

    def __init__(self, order: str, text: str, threshold: float):
        self.order, self.text, self.threshold = order, text, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getMapState("taken", "place bigint", "words string")
        self.places = handle.getMapState("places", "word string", "places string")
        self.count = handle.getValueState("count", "n bigint")

    def _leads(self, words: list[str]) -> list[str]:
        return words[: len(words) - math.ceil(self.threshold * len(words) - 1e-9) + 1]

    def _near(self, words: list[str]) -> bool:
        met = {p for w in self._leads(words) if self.places.containsKey((w,)) for p in self.places.getValue((w,))[0].split(",")}
        for place in met:
            other = self.taken.getValue((int(place),))[0].split(" ")
            both = len(set(words).intersection(other))
            if both >= self.threshold * (len(words) + len(other) - both):
                return True
        return False

    def _take(self, words: list[str]) -> None:
        place = self.count.get()[0] if self.count.exists() else 0
        self.count.update((place + 1,))
        self.taken.updateValue((place,), (" ".join(words),))
        for w in self._leads(words):
            held = self.places.getValue((w,))[0] + "," if self.places.containsKey((w,)) else ""
            self.places.updateValue((w,), (f"{held}{place}",))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        part = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        kept = []
        for text in part[self.text]:
            words = sorted(set((text or "").lower().split()))
            kept.append(not words or not self._near(words))
            if words and kept[-1]:
                self._take(words)
        yield part[kept]

    def close(self) -> None:
        pass


def stream_without_near_duplicates(questions: DataFrame, group: str, order: str, text: str, threshold: float = 0.8) -> DataFrame:
    """Rows of each group without near duplicates of rows taken before: what the batch fold over the same rows in the same order keeps.

    Needs the state store in RocksDB (spark.sql.streaming.stateStore.providerClass). A started query goes on from its checkpoint. Rows of
    one batch are taken in order; a batch of one group is in one task, its state is on disk. Null and empty texts resemble nothing.
    """
    narrow = questions.select(group, order, text)
    return narrow.groupBy(group).transformWithStateInPandas(TakenQuestions(order, text, threshold), narrow.schema, "Append", "None")
