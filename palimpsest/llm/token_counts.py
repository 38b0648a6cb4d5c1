"""Token counts of whole texts under a unigram model, by dynamic programming shared along a trie of pre-tokens.

A pre-token is a run of ``[^\\x20\\x09-\\x0D]`` with the vocabulary's word mark before it.  The distinct pre-tokens of a
batch are inserted in sorted order, which walks their trie depth first: the forward scores on the path from the root
stay in place, so each shared prefix is scored once, and each pre-token's end stores its count.  Counts of pre-tokens
are kept between batches up to a bound.

The vocabulary file holds byte-pair merges whose ranks stand for frequency; the model gives the piece of rank r the
probability proportional to 1 / (r + 1), and a character outside the vocabulary its bytes.  Among equally likely splits
the one with fewer pieces counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_text, pieces, prepare, text_buffer

MARK = "▁"
#: Counts that a worker keeps; more are forgotten and computed again.
KEPT_COUNTS = 400_000
_models: dict[str, tuple] = {}
_counts: dict[str, dict[bytes, int]] = {}


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def model(path: str) -> tuple[dict[str, float | None], float]:
    """Log-probability of each piece, None for what only ends pieces; and the log-probability of a byte."""
    if path not in _models:
        import sentencepiece
        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [processor.id_to_piece(i) for i in range(processor.get_piece_size())
                 if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))]
        _models[path] = suffixes({piece: -math.log(rank + 1) for rank, piece in enumerate(plain, 1)}), -math.log(len(plain) + 2)
    return _models[path]


def suffixes(scores: dict[str, float]) -> dict[str, float | None]:
    known: dict[str, float | None] = {}
    for piece in scores:
        for at in range(len(piece)):
            known.setdefault(piece[at:], None)
    known.update(scores)
    return known


class Walk:
    """The path from the root to the current node of the trie, with the best score and count of each prefix on it."""

    def __init__(self, scores: dict[str, float | None], byte_score: float):
        self.scores, self.byte_score = scores, byte_score
        self.path, self.best, self.count = "", [0.0], [0]

    def end(self, token: str) -> int:
        """The count at the end of ``token``; only nodes that the last token did not share are computed."""
        shared = 0
        for a, b in zip(self.path, token):
            if a != b:
                break
            shared += 1
        del self.best[shared + 1:], self.count[shared + 1:]
        best, count, scores = self.best, self.count, self.scores
        for end in range(shared + 1, len(token) + 1):
            # a character without a piece of its own costs its bytes
            top = fewest = None
            begin = end - 1
            while begin >= 0:
                piece = token[begin:end]
                if piece not in scores:
                    break
                score = scores[piece]
                if score is not None:
                    score += best[begin]
                    if top is None or score > top or score == top and count[begin] + 1 < fewest:
                        top, fewest = score, count[begin] + 1
                begin -= 1
            if scores.get(token[end - 1]) is None:
                size = len(token[end - 1].encode("utf-8", "surrogatepass"))
                score = best[end - 1] + size * self.byte_score
                if top is None or score > top or score == top and count[end - 1] + size < fewest:
                    top, fewest = score, count[end - 1] + size
            best.append(top)
            count.append(fewest)
        self.path = token
        return count[-1]


def _count_task(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _counts.setdefault(path, {})
        scores, byte_score = model(path)
        for batch in pieces(batches, "text"):
            data, bounds = text_buffer(batch.column("text"))
            data, bounds = data.tobytes(), bounds.tolist()
            found = [data[a:b].split() for a, b in zip(bounds, bounds[1:])]
            fresh = set().union(*found).difference(known)
            if len(known) + len(fresh) > KEPT_COUNTS:
                known.clear()
                fresh = set().union(*found)
            walk = Walk(scores, byte_score)
            for word in sorted(fresh):
                known[word] = walk.end(MARK + word.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([b - a for a, b in zip(bounds, bounds[1:])], pa.int64()), pa.array([len(w) for w in found], pa.int64()),
                pa.array([sum(map(known.__getitem__, w)) for w in found], pa.int64())], names=["id", "n_bytes", "n_words", "n_tokens"])

    return work


def token_counts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id, n_bytes, n_words, n_tokens`` of each row's whole text.

    Null and empty texts and those of blanks alone have no tokens.  Rows that repeat are counted each; an empty table gives
    an empty result; other columns are ignored.  ``vocabulary`` is the path of a piece vocabulary that all executors have.
    """
    prepare(df.sparkSession)
    kind = dict(df.dtypes)[id_column]
    rows = df.select(F.col(id_column).alias("id"), as_text(F.col(text_column)).alias("text"))
    return rows.mapInArrow(_count_task(vocabulary or default_vocabulary()), f"id {kind}, n_bytes bigint, n_words bigint, n_tokens bigint")
