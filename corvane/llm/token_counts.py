"""Token counts under a unigram vocabulary by dynamic programming that is shared along a trie.

A task's distinct pre-tokens, in sorted order, are the depth-first walk of their trie: the stack holds the forward score
at each character of the path, and a pre-token computes only the characters below the prefix that it shares with the one
before. At a pre-token's end its count is stored, and each text sums the counts of its pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The sign that stands before each pre-token, as the vocabulary has it.
BLANK = "▁"
#: Counts that a task holds; when there are more, it starts afresh.
HELD = 400_000


@dataclass(frozen=True)
class Vocabulary:
    """Log-probability of each piece; what no piece covers is spelt in UTF-8 bytes, each at ``byte_score``."""

    scores: dict[str, float]
    byte_score: float

    @staticmethod
    def ranked(pieces: Iterable[str]) -> Vocabulary:
        """Scores by Zipf's law from the order of the pieces, the most frequent first: ln(1 / (rank + 2.7)), normalised."""
        order = list(dict.fromkeys(pieces))
        total = log(sum(1 / (r + 2.7) for r in range(len(order)))) if order else 0.0
        return Vocabulary({p: -log(r + 2.7) - total for r, p in enumerate(order)}, -log(len(order) + 2.7) - total - 10)

    @staticmethod
    def from_model(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        return Vocabulary.ranked(model.id_to_piece(i) for i in sorted(ids, key=lambda i: (-model.get_score(i), i)))


class TrieCounter:
    """Counts of pre-tokens under a vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.scores, self.byte_score = vocabulary.scores, vocabulary.byte_score
        self.suffixes = {p[i:] for p in vocabulary.scores for i in range(len(p))}
        self.counts: dict[str, int] = {}
        self.computed = 0

    def add(self, pre_tokens: Iterable[str]) -> None:
        """Stores the counts of pre-tokens that have none. Of equally good spellings the one with fewer tokens counts."""
        get, suffixes = self.scores.get, self.suffixes
        score, count, before = [0.0], [0], ""
        for word in sorted(pre_tokens):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del score[shared + 1 :], count[shared + 1 :]
            self.computed += len(word) - shared
            for end in range(shared + 1, len(word) + 1):
                n_bytes = len(word[end - 1].encode("utf-8", "replace"))
                best, fewest = score[end - 1] + n_bytes * self.byte_score, count[end - 1] + n_bytes
                for start in range(end - 1, -1, -1):
                    piece = word[start:end]
                    if piece not in suffixes:
                        break
                    own = get(piece)
                    if own is not None:
                        total = score[start] + own
                        if total > best or (total == best and count[start] + 1 < fewest):
                            best, fewest = total, count[start] + 1
                score.append(best)
                count.append(fewest)
            self.counts[word] = count[-1]
            before = word


def pre_tokens(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8: runs of other characters than blanks."""
    return (text or "").encode("utf-8", "replace").split()


def count_tokens(documents: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_pre_tokens and n_tokens of each row's whole text, in one pass without a shuffle. Null counts as empty."""
    vocabulary = documents.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.from_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held = TrieCounter(vocabulary.value), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                words = [pre_tokens(x.as_py()) for x in part.column("text")]
                new = set().union(*words).difference(held) if words else set()
                if len(held) + len(new) > HELD:
                    held, new = {}, set().union(*words)
                as_text = {w: BLANK + w.decode("utf-8", "replace") for w in new}
                counter.counts = {}
                counter.add(set(as_text.values()))
                held.update((w, counter.counts[t]) for w, t in as_text.items())
                n = [sum(map(held.__getitem__, w)) for w in words]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_pre_tokens", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_pre_tokens bigint, n_tokens bigint")
