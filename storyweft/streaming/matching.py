"""The greedy pass on a stream: each collection's stories are keyed state of which a batch writes what it changed."""

from __future__ import annotations

import pickle
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from storyweft.functions import scoring
from storyweft.operators.dedup import GREEDY, Greedy, Vectors, place_all, prepared

#: Vectors of a run; runs are written once they are full, and the last one with each batch.
RUN = 256
DAY_MS = 86_400_000


class _Kept(dict):
    """A dictionary over map state: reads what is asked for, writes back what was set."""

    def __init__(self, state, encode=str):
        super().__init__()
        self.state, self.encode, self.changed = state, encode, set()

    def __contains__(self, key) -> bool:
        return super().__contains__(key) or self.state.containsKey((self.encode(key),))

    def __missing__(self, key):
        if not self.state.containsKey((self.encode(key),)):
            raise KeyError(key)
        value = pickle.loads(self.state.getValue((self.encode(key),))[0])
        super().__setitem__(key, value)
        return value

    def get(self, key, default=None):
        return self[key] if key in self else default

    def setdefault(self, key, default=None):
        if key not in self:
            self[key] = default
        self.changed.add(key)
        return self[key]

    def __setitem__(self, key, value) -> None:
        self.changed.add(key)
        super().__setitem__(key, value)

    def save(self) -> None:
        for key in self.changed:
            self.state.updateValue((self.encode(key),), (pickle.dumps(super().__getitem__(key)),))


class KeptGreedy(Greedy):
    """A collection's stories over state. Stories and exact keys are read one by one. Of the lexical step's candidates only the
    newest are listed; one that is seen again comes back by its record. Vectors are read in runs when an article comes
    to the semantic step, and only the last run is written."""

    def __init__(self, lookback_days: int, as_of: float | None, candidates: int, kept: dict, listed: dict | None, runs):
        super().__init__(lookback_days, as_of, candidates)
        self.stories, self.by_url, self.by_item, self.by_hash, self.member_of = (kept[k] for k in ("stories", "by_url", "by_item", "by_hash", "member_of"))
        listed = listed or {"newest": [], "run": 0}
        self.newest, self.run, self.runs, self.read, self.fresh = listed["newest"], listed["run"], runs, False, []

    def open_story(self, story, representative, first, last, title="", url="", active=True) -> None:
        if representative is not None and representative["vector"] is not None:
            self.fresh.append(story)
        super().open_story(story, representative, first, last, title, url, active)
        del self.newest[: -self.candidates]

    def join_story(self, story: int, a: dict) -> None:
        """Of a key's members only the one matched last can be chosen, as nothing is withdrawn on a stream."""
        self.member_of[a["article_id"]] = story
        self.by_item[(a["source"], a["source_item_id"])] = [a["article_id"]]
        self.by_hash[a["content_hash"]] = [a["article_id"]]

    def seen_again(self, story: int, before: float) -> None:
        own = self.stories[story]
        self.stories[story] = own
        if own["last"] != before:
            i = bisect_left(self.newest, (before, story))
            if i < len(self.newest) and self.newest[i] == (before, story):
                del self.newest[i]
            insort(self.newest, (own["last"], story))
            del self.newest[: -self.candidates]
        if own["seed"]["vector"] is not None and "run" in own and not self.runs.containsKey((own["run"],)):  # its run has expired
            del own["run"]
            self.fresh.append(story)
            self.vectors.setdefault(own["seed"]["model"], Vectors()).add(story, own["seed"]["vector"])

    def semantic(self, a: dict) -> dict | None:
        if a["vector"] is not None and not self.read:
            mine, self.vectors, self.read = self.vectors, {}, True
            for _, (run,) in self.runs.iterator():
                for story, model, v in pickle.loads(run):
                    self.vectors.setdefault(model, Vectors()).add(story, np.frombuffer(v))
            known = {model: set(x.of) for model, x in self.vectors.items()}
            for model, own in mine.items():
                for story, v in zip(own.of, own.rows):
                    if story not in known.get(model, ()):
                        self.vectors.setdefault(model, Vectors()).add(story, v)
        return super().semantic(a)

    def save(self) -> dict:
        last = pickle.loads(self.runs.getValue((self.run,))[0]) if self.fresh and self.runs.containsKey((self.run,)) else []
        for story in self.fresh:
            own = self.stories[story]
            self.stories[story] = own | {"run": self.run}
            last.append((story, own["seed"]["model"], own["seed"]["vector"].tobytes()))
            if len(last) == RUN:
                self.runs.updateValue((self.run,), (pickle.dumps(last),))
                self.run, last = self.run + 1, []
        if self.fresh and last:
            self.runs.updateValue((self.run,), (pickle.dumps(last),))
        for kept in (self.stories, self.by_url, self.by_item, self.by_hash, self.member_of):
            kept.save()
        return {"newest": self.newest, "run": self.run}


class Cascade(StatefulProcessor):
    """One collection's articles of each micro-batch, in id order."""

    def __init__(self, lookback_days: int, as_of: float | None, candidates: int, keep_days: float | None):
        self.how, self.keep = (lookback_days, as_of, candidates), keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Exact keys and stories stay for good; what only the semantic step reads may expire.
        self.maps = {name: handle.getMapState(name, "key string", "value binary") for name in ("stories", "by_url", "by_item", "by_hash", "member_of")}
        self.listed = handle.getValueState("listed", "value binary")
        self.runs = handle.getMapState("runs", "run int", "value binary", None if self.keep is None else int(self.keep * DAY_MS))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        listed = pickle.loads(self.listed.get()[0]) if self.listed.exists() else None
        greedy = KeptGreedy(*self.how, {name: _Kept(state, repr) for name, state in self.maps.items()}, listed, self.runs)
        out = place_all(greedy, pd.concat(list(rows), ignore_index=True))
        self.listed.update((pickle.dumps(greedy.save()),))
        yield out

    def close(self) -> None:
        pass


def stream_stories(articles: DataFrame, lookback_days: int = scoring.LOOKBACK_DAYS, as_of: float | None = None, candidates: int = scoring.LEXICAL_CANDIDATES, keep_days: float | None = None) -> DataFrame:
    """Outcomes of new articles, appended; columns as greedy_stories takes them. Within a micro-batch articles come in
    id order; a late one is placed among the stories there are, one that is a member already is passed over.

    State is kept by URL, item, content, member and story, so that a batch writes what it changed, not its collections. as_of and
    lookback_days set the horizon. keep_days lets vectors expire that no batch has written for so long (processing time; at least
    lookback_days, for equal results); a story that is seen again later brings its vector back. A stream with it has batches without
    data, so it does not end by itself. Sets the session's state store to RocksDB, which such state needs."""
    articles.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    processor = Cascade(lookback_days, as_of, candidates, keep_days)
    return prepared(articles).groupBy("collection").transformWithStateInPandas(processor, GREEDY, "append", "none" if keep_days is None else "processingTime")
