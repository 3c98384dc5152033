"""Token counts of documents by a unigram model, with one dynamic program per shared prefix.

The distinct pre-tokens of a batch form a trie. Sorted, they visit it depth first, so
the forward scores on the path from the root are all that has to be kept: a prefix that
many pre-tokens share is scored once. The count at each terminal node is stored, and
documents add up the counts of their pre-tokens.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vocabulary whose pieces are listed by rank; any other path can be given.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Pre-tokens whose counts a task keeps; beyond it starts afresh, and scores again what returns.
KEPT = 400_000
#: Bytes of a text that are split at a time, at white space.
PART = 1 << 20
#: Pre-tokens that are looked at together.
TOGETHER = 500_000
_WHITE = re.compile(rb"\s")


@dataclass
class Unigram:
    """scores: log-probability by piece; lengths: of the pieces that end in a character; unknown: of a character without a piece."""

    scores: dict[str, float]
    lengths: dict[str, list[int]]
    unknown: float


def unigram(scores: dict[str, float]) -> Unigram:
    ends: dict[str, set[int]] = {}
    for piece in scores:
        ends.setdefault(piece[-1], set()).add(len(piece))
    return Unigram(scores, {c: sorted(n) for c, n in ends.items()}, min(scores.values(), default=0.0) - 10.0)


def load_unigram(path: str = MODEL) -> Unigram:
    """The pieces of a SentencePiece file with probabilities by Zipf's law, 1 / rank; special and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    norm = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return unigram({p: -math.log(r) - norm for r, p in enumerate(pieces, 1)})


def terminal_counts(pretokens: Iterable[bytes], model: Unigram) -> dict[bytes, int]:
    """Tokens in the best segmentation of each distinct pre-token.

    Each is read with the space mark in front. A character that is no piece
    counts as many tokens as it has bytes. Of equal scores fewer tokens win.
    """
    scores, lengths, unknown = model.scores, model.lengths, model.unknown
    out: dict[bytes, int] = {}
    path, best, count = "", [0.0], [0]
    for raw, text in sorted(((p, SPACE + p.decode("utf-8", "replace")) for p in pretokens), key=lambda x: x[1]):
        shared, most = 0, min(len(path), len(text))
        while shared < most and path[shared] == text[shared]:
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for d in range(shared, len(text)):
            c, top, n = text[d], -math.inf, 0
            for k in lengths.get(c, ()):
                if k > d + 1:
                    break
                s = scores.get(text[d + 1 - k : d + 1])
                if s is not None:
                    s += best[d + 1 - k]
                    m = count[d + 1 - k] + 1
                    if s > top or s == top and m < n:
                        top, n = s, m
            if c not in scores:
                s = best[d] + unknown
                if s > top:
                    top, n = s, count[d] + len(c.encode("utf-8", "replace"))
            best.append(top)
            count.append(n)
        path = text
        out[raw] = count[len(text)]
    return out


def parts(text: bytes) -> Iterator[list[bytes]]:
    """The pre-tokens of a text: runs without ASCII white space, a bounded part at a time."""
    at = 0
    while at < len(text):
        end = len(text)
        if at + PART < end and (m := _WHITE.search(text, at + PART)):
            end = m.start()
        yield text[at:end].split()
        at = end


def gathered(texts: pa.Array) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(row, pre-tokens) of the parts of all texts, in groups of about TOGETHER pre-tokens: each group shares a trie."""
    group, size = [], 0
    for row, t in enumerate(texts):
        for words in parts(t.as_py() or b""):
            group.append((row, words))
            size += len(words)
            if size >= TOGETHER:
                yield group
                group, size = [], 0
    if group:
        yield group


def token_counts(docs: DataFrame, model: Unigram, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_tokens; null, empty and blank texts have 0 of both.

    The vocabulary is broadcast, which its file bounds. No row is shuffled: each
    task builds the trie of its own pre-tokens. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        for b in batches:
            totals = [[0, 0] for _ in range(b.num_rows)]
            for group in gathered(b.column(1)):
                fresh = {w for _, words in group for w in words if w not in kept}
                if fresh:
                    if len(kept) > KEPT:
                        kept, fresh = {}, {w for _, words in group for w in words}
                    kept.update(terminal_counts(fresh, shared.value))
                for row, words in group:
                    totals[row][0] += len(words)
                    totals[row][1] += sum(map(kept.__getitem__, words))
            columns = [pa.array([x[k] for x in totals], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, n_words long, n_tokens long")


def op2_token_counts(spark, sf_dir) -> DataFrame:
    """doc_id, n_words, n_tokens of all of ``documents``."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), load_unigram()).withColumnRenamed("id", "doc_id")
