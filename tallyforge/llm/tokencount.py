"""Token counts of a unigram vocabulary by a Viterbi that carries scores and counts only."""

from __future__ import annotations

import re
from math import inf
from operator import itemgetter

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import table

#: Words whose counts a Python worker remembers at a time; longer words are not remembered.
REMEMBERED, LONGEST = 1_000_000, 64
#: What an unknown character scores below the least piece.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"


class UnigramCounter:
    """Piece counts of whole texts under the pieces and scores of a SentencePiece model file.

    An Aho-Corasick automaton finds the pieces that end at each character. The best path to a
    character is carried as its score and its number of pieces. Scores are added in double
    precision, which is exact for whole-number scores; the tokenizer library adds in single
    precision, and from sums beyond 2^24 on (long texts, unknown characters) its choices follow
    rounding errors that are not copied here. The tokenizer fills its table by the start of a piece and replaces an
    entry only by a better score, so among equal scores the longest last piece wins. On some words the library's
    default search returns a path that is not its best (for `the` one piece of score -13, where two pieces have -8);
    its own n-best search returns the path that is counted here. A
    character that no piece of its own covers can also be unknown; with byte pieces in the
    vocabulary it counts one piece for each of its UTF-8 bytes.

    No path crosses from other text into a space mark, because no piece holds a space mark
    after another character. Words, each with the space marks before it, are therefore counted
    one by one, and a word met before is looked up.
    """

    _by_path: dict[str, UnigramCounter] = {}

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.processor
        self.automaton = ahocorasick.Automaton()
        scores, self.fallback = [], False
        for i in range(model.vocab_size()):
            if model.is_byte(i):
                self.fallback = True
            if model.is_byte(i) or model.is_unknown(i) or model.is_control(i) or model.is_unused(i):
                continue
            piece, score = model.id_to_piece(i), model.get_score(i)
            scores.append(score)
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} holds a space mark after another character")
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        # a line break that no piece holds is a word of its own
        breaks = "" if any("\n" in p for p in self.automaton) else "\n"
        self.words = re.compile(f"{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+" + (f"|{breaks}" if breaks else "")).findall
        self.unknown = min(scores) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> UnigramCounter:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def word(self, text: str) -> int:
        """The piece count of one word by dynamic programming over its characters."""
        size = len(text)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, match in self.automaton.iter(text):
            ending[end].append(match)
        best = [0.0] * (size + 1)
        count = [0] * (size + 1)
        for end in range(size):
            top, pieces, single = -inf, 0, False
            for length, score in ending[end]:  # the automaton gives the longest, which starts first, first
                single |= length == 1
                total = score + best[end + 1 - length]
                if total > top:
                    top, pieces = total, count[end + 1 - length] + 1
            if not single and self.unknown + best[end] > top:
                top = self.unknown + best[end]
                pieces = count[end] + (len(text[end].encode("utf-8", "surrogatepass")) if self.fallback else 1)
            best[end + 1], count[end + 1] = top, pieces
        return count[size]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = self.words(self.processor.normalize(text))
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = set(words).difference(known)
        known.update((w, self.word(w)) for w in new)
        total = sum(itemgetter(*words)(known) if len(words) > 1 else [known[w] for w in words])
        for word in new:
            if len(word) > LONGEST:
                del known[word]
        return total


def with_token_count(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the number of pieces of each whole text; null and empty texts have none.

    Rows are counted one by one without a shuffle. A column named like `out` is replaced.
    """

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        counter = UnigramCounter.of(model_path)
        return pd.Series([counter.count(None if x is None or x is pd.NA else x) for x in texts], dtype="int64")

    return docs.withColumn(out, counted(F.col(text_col).cast("string")))


def op9_count_viterbi(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Token counts of all documents: doc_id, n_bytes, n_tokens.

    Null texts have 0 bytes and 0 tokens, like empty ones. Repeated rows and null ids are kept.
    An empty table gives no rows; other columns are not read.
    """
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = with_token_count(docs, model_path)
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens")
