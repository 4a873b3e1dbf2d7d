"""Token ids of whole texts, exact but fast: each distinct word is encoded once per worker."""

from __future__ import annotations

import json
import operator
import os
import re
from itertools import repeat

import numpy as np
from tokenizers import Tokenizer, models, pre_tokenizers

from storyweft.llm.common import cached

TOKENIZER = "word_bpe_49k.json"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class _NotByWord(Exception):
    """The file does not end each run of letters with one end-of-word token."""


class WordEncoder:
    """Encodes texts with a tokenizers file.

    When the file's own rules cut at white space and drop it, a text's ids are the ids of its words one after the
    other, so words are looked up in a bounded cache; only unknown words reach the tokenizer, many in one call.
    A word is cut once more after a leading run of Latin letters if an ASCII character follows, for the same reason. Any other file gets whole texts.
    """

    #: A line's first run of Latin-1 letters, and the rest.
    CUT = re.compile(r"^([A-Za-zÀ-ÖØ-öø-ÿ]*+)(.*)$", re.M)

    def __init__(self, path: str, limit: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 65536 else "<u4")
        self.limit = limit
        self.words: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.by_word = self._cuts_at_space(spec)
        self.end = spec["model"].get("end_of_word_suffix") or ""
        ends = np.zeros(max(vocab.values()) + 1, bool)
        if self.end:
            ends[[i for t, i in vocab.items() if t.endswith(self.end)]] = True
        self.ends = ends
        if self.by_word and self.end:  # letter runs are normal already: the same merges without the normalizers
            merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
            self.lean = Tokenizer(models.BPE(vocab=spec["model"]["vocab"], merges=merges, end_of_word_suffix=self.end, cache_capacity=0))
            self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    @staticmethod
    def _cuts_at_space(spec: dict) -> bool:
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        kinds = [x.get("type") for x in norm.get("normalizers", [])]
        splits = pre.get("pretokenizers", [{}])
        first = splits[0]
        return kinds == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "") and [x.get("use_regex") for x in splits[1:]] == [False] and not any(x["lstrip"] or x["rstrip"] or x["normalized"] or x["single_word"] for x in spec.get("added_tokens", [])) and spec.get("post_processor") is None

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _learn_runs(self, fresh: list[str]) -> None:
        found = self.lean.encode_batch_fast([" ".join(fresh[i : i + 64]) for i in range(0, len(fresh), 64)])
        ids = np.concatenate([np.array(x.ids, self.dtype) for x in found])
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
        if len(stops) != len(fresh):  # this file has word ends within words
            raise _NotByWord
        raw = ids.tobytes()
        self.runs.update(zip(fresh, [raw[a:b] for a, b in zip([0, *stops], stops)]))

    def _learn(self, fresh: list[bytes]) -> None:
        """Words hold no line end, so all are cut in one pass."""
        text = b"\n".join(fresh).decode("utf-8", "replace")
        if not self.end:
            self.words.update(zip(fresh, self._plain(text.split("\n"))))
            return
        cut = self.CUT.findall(text)
        runs = "\n".join([run for run, _ in cut]).lower().split("\n")
        if len(self.runs) + len(fresh) > 2 * self.limit:
            self.runs.clear()
        new = list(set(runs).difference(self.runs, ("",)))
        if new:
            self._learn_runs(new)
        self.runs[""] = b""
        tails = [tail for _, tail in cut]
        if len(self.tails) + len(fresh) > self.limit:
            self.tails.clear()
        self.tails[""] = b""
        new = [t for t in set(tails).difference(self.tails) if t[0] < "\x80"]
        self.tails.update(zip(new, self._plain(new)))
        self.words.update(zip(fresh, map(operator.concat, map(self.runs.__getitem__, runs), map(self.tails.get, tails, repeat(b"")))))
        whole = [i for i, t in enumerate(tails) if t and t[0] >= "\x80"]  # its letters may go on, or combine
        if whole:
            self.words.update(zip([fresh[i] for i in whole], self._plain(["".join(cut[i]) for i in whole])))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text as little-endian numbers of self.dtype; null counts as empty."""
        if not self.by_word:
            found = self.tokenizer.encode_batch([(t or b"").decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [np.array(x.ids, self.dtype).tobytes() for x in found]
        split = [(t or b"").split() for t in texts]
        fresh = set().union(*split).difference(self.words)
        if fresh:
            if len(self.words) + len(fresh) > self.limit:
                self.words.clear()
                fresh = set().union(*split)
            try:
                self._learn(list(fresh))
            except _NotByWord:
                self.by_word = False
                return self.encode(texts)
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]


def encoder(path: str) -> WordEncoder:
    """One per Python worker and file, kept between tasks."""
    return cached(("encoder", path), lambda: WordEncoder(path))
