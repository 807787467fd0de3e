"""Token counts under a unigram vocabulary: count-only Viterbi over Aho-Corasick matches."""

from __future__ import annotations

import math
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import small_batches, table

#: Stands for the white space before a word.
MARK = "▁"
#: What an unknown character costs below the worst piece: 10 in the unit of log-probabilities, in thousandths.
UNKNOWN = 10_000
#: Characters at which str.split() parts words and the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words whose counts a worker keeps, at most.
KEPT_WORDS = 400_000


def vocabulary(model_path: str) -> dict[str, int]:
    """Pieces of a SentencePiece file with unigram scores: log-probabilities by Zipf's law from the pieces' order,
    in thousandths, whole numbers so that sums are the same in any order. Control, unknown and byte pieces and
    those that would reach over a word's start are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    out: dict[str, int] = {}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k):
            continue
        piece = model.id_to_piece(k)
        if MARK not in piece[1:]:
            out[piece] = -round(1000 * math.log(len(out) + 12))
    return out


class Counter:
    """Pieces and score of the best segmentation, by the tie rules of the usual unigram tokenizers.

    From the left, a piece replaces what reaches its end only with a better score; so of equal ones that
    with the earliest start stays. A character that is no piece by itself may be unknown, at UNKNOWN below
    the worst score; unknown characters next to each other are one piece. No piece reaches over a word's
    start, so words are independent and their results are kept.
    """

    def __init__(self, pieces: dict[str, int]):
        self._find = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self._find.add_word(piece, (len(piece), score))
        if pieces:
            self._find.make_automaton()
        self._iter = self._find.iter if pieces else lambda s: ()
        self._unknown = min(pieces.values(), default=0) - UNKNOWN
        outer = self

        class Kept(dict):
            def __missing__(self, word: str) -> int:
                n, score = outer.segment(MARK + word)
                value = (-score << 40) + n
                if len(self) < KEPT_WORDS and len(word) < 64:
                    self[word] = value
                return value

        self._kept = Kept()

    def segment(self, text: str) -> tuple[int, int]:
        n = len(text)
        best, count, unknown = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        found = iter(self._iter(text))
        match = next(found, None)
        for end in range(1, n + 1):
            top, length, single = None, 0, False
            while match is not None and match[0] == end - 1:
                size, score = match[1]
                single |= size == 1
                score += best[end - size]
                if top is None or score > top or (score == top and size > length):
                    top, length = score, size
                match = next(found, None)
            other = best[end - 1] + self._unknown
            if not single and (top is None or other > top):
                best[end], unknown[end] = other, True
                count[end] = count[end - 1] + (not unknown[end - 1])
            else:
                best[end], count[end] = top, count[end - length] + 1
        return count[n], best[n]

    def __call__(self, words: list[str]) -> tuple[int, int]:
        total = sum(map(self._kept.__getitem__, words))
        return total & ((1 << 40) - 1), -(total >> 40)


def words_of(text: str) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return _WORD.findall(text) if _ODD.search(text) else text.split()


_counters: dict[str, Counter] = {}


def counter(model_path: str) -> Counter:
    if model_path not in _counters:
        _counters[model_path] = Counter(vocabulary(model_path))
    return _counters[model_path]


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, score - long): words apart by blanks, tabs and line ends, pieces of the whole
    text, of any length, and the best segmentation's score in thousandths; ties by the tokenizer's rules. Null and empty texts
    have zeros. Rows are independent, equal ones have equal results; other columns are not read; an empty input gives an empty result.
    """

    small_batches(docs.sparkSession)

    def counted(batches):
        count = counter(model_path)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                words = words_of(text or "")
                rows.append((len(words), *count(words)))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "n_words", "n_tokens", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, n_words long, n_tokens long, score long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the 32k vocabulary."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
