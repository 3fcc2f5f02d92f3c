"""Token counts from distinct pre-tokens, counted once each and joined to the frequencies of documents."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import written

#: White-space runs, the most frequent ones, whose counts every task holds: at most 16 bytes each. The others are joined by a shuffle.
HELD = 1 << 18
#: Runs of ASCII characters given to the pre-tokenizer at once.
AT_ONCE = 2_000
_PROBE = ("a", "don't", "12", "#*(", "é", "é", "́x", "I'LL", "​z", "六七", "x_y-z", ",.", "\x00q")


class Vocabulary:
    """A ``.json`` vocabulary of the tokenizers library, taken apart: special strings, normalizer, pre-tokenizer, merges."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        if any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(re.search(r"\s", a["content"]) for a in added):
            raise ValueError("added tokens of this vocabulary depend on what stands beside them")
        longest_first = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if added else None
        for blank in (" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c"):
            if self._split(blank.join(_PROBE)) != [p for run in _PROBE for p in self._split(run)] or self._split(blank):
                raise ValueError("pre-tokens of this vocabulary reach across white space")

    def _split(self, text: str) -> list[str]:
        t = self.tokenizer
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(text)] if t.pre_tokenizer else [text] * bool(text)

    def pre_tokens(self, run: str) -> list[str]:
        """Pre-tokens of a run without white space; special strings are pre-tokens too, marked by a blank before them."""
        if self.special is None:
            return self._split(run)
        out, at = [], 0
        for m in self.special.finditer(run):
            out += self._split(run[at : m.start()])
            out.append(" " + m[0])
            at = m.end()
        return out + self._split(run[at:])

    def of_all(self, runs: list[str]) -> list[list[str]]:
        """Pre-tokens of each run. Those of ASCII characters without a special string go together, joined by blanks, at which pre-tokens end."""
        out: list[list[str]] = [[] for _ in runs]
        plain = []
        for i, run in enumerate(runs):
            if run.isascii() and not (self.special and self.special.search(run)):
                plain.append(i)
            else:
                out[i] = self.pre_tokens(run)
        t = self.tokenizer
        for k in range(0, len(plain), AT_ONCE):
            some = plain[k : k + AT_ONCE]
            text = " ".join(runs[i] for i in some)
            text = t.normalizer.normalize_str(text) if t.normalizer else text
            ends = [m.start() for m in re.finditer(" ", text)]
            if len(ends) != len(some) - 1 or t.pre_tokenizer is None:  # this normalizer adds or removes blanks
                for i in some:
                    out[i] = self.pre_tokens(runs[i])
                continue
            place = 0
            ends.append(len(text))
            for p, (start, _) in t.pre_tokenizer.pre_tokenize_str(text):
                while start > ends[place]:
                    place += 1
                out[some[place]].append(p)
        return out

    def pieces(self, pre_token: str) -> int:
        return 1 if pre_token.startswith(" ") else len(self.tokenizer.model.tokenize(pre_token))


_LOADED: dict[str, Vocabulary] = {}


def _loaded(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, held: int = HELD) -> DataFrame:
    """Bytes and tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    1. Distinct runs without white space are taken apart into pre-tokens, as the vocabulary's own normalizer and
       pre-tokenizer give them; each distinct pre-token is taken apart into pieces once, and only
       their number is kept. A run has the sum over its pre-tokens.
    2. These numbers are joined to the frequencies of each document: in arrays for the ``held`` most frequent
       runs (a table of bounded size in every task), by a shuffle of (row, run, frequency) for
       the others; then summed by document.

    ``tokenizer`` is the path of a ``.json`` vocabulary of the tokenizers library, there on each
    machine. One whose pre-tokens reach across white space, or whose added tokens depend on their surroundings, is
    refused with a ValueError, as texts are taken apart at ASCII white space first.

    Special strings inside texts count as the library takes them by default. A null or empty
    text has 0 bytes and tokens; a null doc_id stays null; repeated rows give repeated rows;
    further columns are ignored. Runs are joined by 64-bit hashes.
    """
    spark = docs.sparkSession
    _loaded(tokenizer)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            words = W.split(batch.column("text"))
            name, first, n = np.unique(W.hashes(words), return_index=True, return_counts=True)
            runs = [words.text(i).decode("utf-8", "replace") for i in first.tolist()]
            yield pa.RecordBatch.from_pydict({"name": pa.array(W.signed(name), pa.int64()), "run": pa.array(runs, pa.string()), "n": pa.array(n, pa.int64())})

    def pre_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _loaded(tokenizer)
        for batch in batches:
            found = vocabulary.of_all(batch.column("run").to_pylist())
            yield pa.RecordBatch.from_pydict({"name": batch.column("name"), "n": batch.column("n"), "pre_tokens": pa.array(found, pa.list_(pa.string()))})

    def taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _loaded(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"pre_token": batch.column("pre_token"), "pieces": pa.array([vocabulary.pieces(p) for p in batch.column("pre_token").to_pylist()], pa.int64())})

    runs = docs.mapInArrow(distinct, "name long, run string, n long").groupBy("name", "run").agg(F.sum("n").alias("n"))
    runs = written(runs.mapInArrow(pre_tokens, "name long, n long, pre_tokens array<string>"))
    each = runs.select("name", "n", F.explode("pre_tokens").alias("pre_token"))
    apart = each.select("pre_token").distinct().mapInArrow(taken_apart, "pre_token string, pieces long")
    counted = written(each.join(apart, "pre_token").groupBy("name").agg(F.first("n").alias("n"), F.sum("pieces").alias("pieces")))
    top = counted.orderBy(F.col("n").desc(), "name").limit(held).select("name", "pieces").toArrow()
    names, pieces = top.column("name").to_numpy().view(np.uint64), top.column("pieces").to_numpy()
    order = np.argsort(names)
    frequent = spark.sparkContext.broadcast((names[order], pieces[order]))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, pieces = frequent.value
        for batch in W.small(batches):
            words = W.split(batch.column("text"))
            run = W.hashes(words)
            at = np.minimum(np.searchsorted(names, run), max(len(names) - 1, 0))
            hit = names[at] == run if len(names) else np.zeros(len(run), bool)
            sure = np.zeros(len(run), np.int64)
            sure[hit] = pieces[at[hit]]
            total = np.concatenate([[0], np.cumsum(sure)])
            rare = np.concatenate([[0], np.cumsum(~hit)])[words.offsets]
            _, bytes_at = W.utf8(batch.column("text"))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array(np.diff(bytes_at), pa.int64()),
                "sure": pa.array(np.diff(total[words.offsets]), pa.int64()),
                "rare": pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.array(W.signed(run[~hit]), pa.int64())),
            })

    rows = written(docs.mapInArrow(joined, "doc_id long, n_bytes long, sure long, rare array<long>").withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode("rare").alias("name")).groupBy("row", "name").agg(F.count("*").alias("times"))
    rest = rare.join(counted.select("name", "pieces"), "name").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    tokens = F.col("sure") + F.coalesce("more", F.lit(0))
    return rows.join(rest, "row", "left").select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
