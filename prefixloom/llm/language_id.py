"""Operator 4, language identification by segmentation-marginalised unigrams.

Model.  For each language, a probability for every piece of a fixed public vocabulary plus one for any other
character.  A word (a maximal run of letters, lower-cased, with a word-start mark) may be cut into pieces in many ways;
its probability is the sum over all segmentations, by the forward algorithm.  A text's score is the sum of its words' log
probabilities.  Words of more than 32 letters are cut there, so that sums stay in range; all of the text counts.

Fit.  Expectation-maximisation on a bounded sample of rows: of every language, the `sample_documents` labelled training documents with
the smallest hash of id (ties by text hash), and of these all distinct words.  That bound and `most_languages` (the labels with most
training documents; a model has a column a language) are parameters; nothing else is capped.  The vocabulary is never trained.

Prediction reads the text alone.  The language with the largest log probability wins, ties to the smaller name; the score is its
share of exp(mean log probability a word * sqrt(words)), a posterior tempered for the dependence between words.

Null texts and texts without letters give `und` with score 0.  Null languages don't train.  If nothing can be learned
(no labelled row in training), every row is `und`.  Repeated rows each give a row.  Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import idle_memory

MARK = "▁"
WORD = re.compile(r"[^\W\d_]+")
LONGEST_WORD = 32
MOST_WORDS = 300_000
#: Of a task's words, the first so many are kept for the next task of the worker: the frequent ones come early.
KEPT_WORDS = 60_000


def held_out(id_col: str = "doc_id"):
    """crc32(id as text) mod 3 = 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of a public sentencepiece vocabulary, lower-case letters only, by number; 0 is any other character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    good = sorted(p for p in pieces if p == p.lower() and p.lstrip(MARK).isalpha() and MARK not in p[1:])
    return {p: i + 1 for i, p in enumerate(good)}


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased.  The pattern also lets numerals in; parts_of() cuts them out."""
    return WORD.findall((text or "").lower())


def parts_of(word: str) -> list[str]:
    """Letters of a matched word, marked, in parts of bounded length."""
    letters = [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()
    out = []
    for run in letters:
        run = MARK + run
        out += [run[i : i + LONGEST_WORD] for i in range(0, len(run), LONGEST_WORD)]
    return out


LATTICE_WORDS = 20_000


class Lattice:
    """All segmentations of a list of words: for each end, the edges that end there, longest-word padded."""

    def __init__(self, words: list[str], vocab: dict[str, int], longest: int):
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        edges: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        for k, w in enumerate(words):
            n = len(w)
            for a in range(n):
                for b in range(a + 1, min(n, a + longest) + 1):
                    piece = vocab.get(w[a:b])
                    if piece is None:
                        if b > a + 1:
                            continue
                        piece = 0
                    at = edges.get((a, b))
                    if at is None:
                        at = edges[a, b] = ([], [])
                    at[0].append(k)
                    at[1].append(piece)
        self.edges = {ab: (np.array(k), np.array(p)) for ab, (k, p) in edges.items()}

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """(words, positions, languages): mass of the ways to reach each position."""
        width = int(self.lengths.max(initial=0)) + 1
        alpha = np.zeros((len(self.lengths), width, prob.shape[1]))
        alpha[:, 0] = 1.0
        for a, b in sorted(self.edges, key=lambda x: (x[1], x[0])):
            k, p = self.edges[a, b]
            alpha[k, b] += alpha[k, a] * prob[p]
        return alpha

    def log_mass(self, prob: np.ndarray) -> np.ndarray:
        alpha = self.forward(prob)
        return np.log(alpha[np.arange(len(self.lengths)), self.lengths])

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts; weight: (words, languages)."""
        alpha = self.forward(prob)
        rows = np.arange(len(self.lengths))
        beta = np.zeros_like(alpha)
        beta[rows, self.lengths] = 1.0
        for a, b in sorted(self.edges, key=lambda x: (-x[0], x[1])):
            k, p = self.edges[a, b]
            beta[k, a] += beta[k, b] * prob[p]
        total = alpha[rows, self.lengths]
        counts = np.zeros_like(prob)
        for (a, b), (k, p) in self.edges.items():
            np.add.at(counts, p, weight[k] * alpha[k, a] * prob[p] * beta[k, b] / total[k])
        return counts


class LanguageModel:
    def __init__(self, languages: list[str], vocab: dict[str, int], prob: np.ndarray):
        self.languages, self.vocab, self.prob = languages, vocab, prob
        self.longest = max(map(len, vocab), default=1)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages) + 1))

    def __getstate__(self):
        return {"languages": self.languages, "vocab": self.vocab, "prob": self.prob}

    def __setstate__(self, state):
        self.__init__(**state)

    def _learn(self, words: list[str]) -> None:
        """Scores of words not seen before: per language the log mass, and how many parts they have."""
        if len(self.known) + len(words) > MOST_WORDS:
            self.known, self.scores = {}, np.zeros((0, len(self.languages) + 1))
        parts, owner = [], []
        for k, w in enumerate(words):
            for x in parts_of(w):
                parts.append(x)
                owner.append(k)
        rows = np.zeros((len(words), len(self.languages) + 1))
        for i in range(0, len(parts), LATTICE_WORDS):
            mass = Lattice(parts[i : i + LATTICE_WORDS], self.vocab, self.longest).log_mass(self.prob)
            np.add.at(rows, owner[i : i + LATTICE_WORDS], np.column_stack([mass, np.ones(len(mass))]))
        start = len(self.scores)
        self.scores = np.vstack([self.scores, rows])
        self.known.update((w, start + i) for i, w in enumerate(words))

    def trim(self) -> None:
        """Forget all words but the first KEPT_WORDS, so that an idle worker holds little."""
        if len(self.known) > KEPT_WORDS:
            self.known = dict(islice(self.known.items(), KEPT_WORDS))
            self.scores = self.scores[:KEPT_WORDS].copy()

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for i in range(0, len(texts), 256):
            found = [words_of(t) for t in texts[i : i + 256]]
            new = list({w for ws in found for w in ws if w not in self.known})
            if len(self.known) + len(new) > MOST_WORDS:
                new = list({w for ws in found for w in ws})
            if new:
                self._learn(new)
            for ws in found:
                at = np.fromiter(map(self.known.__getitem__, ws), dtype=np.int64, count=len(ws))
                total = self.scores[at].sum(axis=0)
                n, mass = total[-1], total[:-1]
                if not n or not len(mass):
                    names.append("und")
                    scores.append(0.0)
                    continue
                best = int(np.argmax(mass))
                share = np.exp((mass - mass[best]) / np.sqrt(n))
                names.append(self.languages[best])
                scores.append(float(1 / share.sum()))
        return names, scores


def fit(
    df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_documents: int = 200, rounds: int = 4, smoothing: float = 0.02, most_languages: int = 256,
) -> LanguageModel:
    """Fit on the labelled rows that aren't held out; what reaches the driver is bounded by the parameters."""
    train = df.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    train = train.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit(4)).alias("h"),
        F.xxhash64(F.col(text_col)).alias("th"),
    )
    sizes = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    languages = sorted(r["lang"] for r in sizes.collect())
    vocab = vocabulary(vocab_path)
    if not languages:
        return LanguageModel([], vocab, np.zeros((len(vocab) + 1, 0)))
    known = F.broadcast(df.sparkSession.createDataFrame([(x,) for x in languages], "lang string"))  # most_languages at most
    # tasks keep the smallest hashes of each language before the shuffle, so a language with most rows is no hot task
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "th"))
    chosen = train.join(known, "lang").select("lang", "h", "th").withColumn("rank", rank).filter(F.col("rank") <= sample_documents)
    chosen = F.broadcast(chosen.select("lang", "h", "th").distinct())  # most_languages * sample_documents at most

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                yield pd.DataFrame({"lang": lang, "word": sorted({p for w in words_of(text) for p in parts_of(w)}), "n": 1})

    picked = train.join(chosen, ["lang", "h", "th"], "left_semi").dropDuplicates(["lang", "h", "th"])
    words = picked.select("lang", "text").mapInPandas(count, "lang string, word string, n long")
    got = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas().sort_values(["word", "lang"])
    names, at = np.unique(got["word"].to_numpy(dtype=object), return_inverse=True)
    weight = np.zeros((len(names), len(languages)))
    if len(names):
        np.add.at(weight, (at, got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()), got["n"].to_numpy(float))
    longest = max(map(len, vocab), default=1)
    parts = [slice(i, i + LATTICE_WORDS) for i in range(0, len(names), LATTICE_WORDS)]
    lattices = [(Lattice(list(names[p]), vocab, longest), weight[p]) for p in parts]
    prob = np.full((len(vocab) + 1, len(languages)), 1.0 / (len(vocab) + 1))
    for _ in range(rounds):
        counts = sum((lattice.expected(prob, w) for lattice, w in lattices), np.zeros_like(prob)) + smoothing
        prob = counts / counts.sum(axis=0)
    return LanguageModel(languages, vocab, prob)


def predict_languages(df: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """df with pred_col and score_col added (columns of these names are replaced); the text alone is read."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            names, scores = own.predict(batch.column(text_col).to_pylist())
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, pred_col, score_col])
        own.trim()
        idle_memory()

    kept = df.drop(*(c for c in df.columns if c.lower() in (pred_col.lower(), score_col.lower()) and c != text_col))
    schema = StructType(list(kept.schema.fields)).add(pred_col, StringType()).add(score_col, DoubleType())
    return kept.mapInArrow(score, schema)
