"""Language identification by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces, by the forward algorithm; a text's is the product over its words. The language
under which the text is most probable is predicted, and the score is its posterior with equal priors.

The probabilities are learned by expectation maximisation: the expected uses of each piece, over all segmentations
of each distinct word of the training texts, are computed in tasks and summed by Spark. ``docs_per_language`` bounds
the training sample: of each language's documents, a share by a hash of doc_id is taken that comes to that number.
All sums are scaled place by place, so no word is too long and no probability too small. A piece that a language's
texts do not use has the same small probability in every language, whatever their sizes.

Words are runs of letters, lower-cased. Defined cases: a null text, or one without a letter, is ``und`` with score
0; so is every text when there is nothing to learn from. Documents without an id or a language are not learned
from. A letter that is no piece counts as an unknown one, equally improbable in all languages; of equally probable
languages the first by name is predicted. For learning, a word of more than ``LONG`` letters counts as several. Repeated rows are predicted each on its own, and columns other than those
named are not read. Of more than ``LANGUAGES_AT_ONCE`` languages, blocks of so many are scored one after the other.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm import tokens
from talweg.session import cut, stored

WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"  # begins a word in the vocabulary
#: Words of up to so many letters share tables, longer ones are worked off alone in less memory: the same sums.
LONG = 40
#: Places between two scalings in a table: no product of so many small probabilities underflows.
RESCALED = 8
DOCS_PER_LANGUAGE = 2_000
LANGUAGES_AT_ONCE = 200
ROUNDS = 3
#: The probability, in every language, of a piece that its texts do not use, and of a letter that is no piece.
UNSEEN = 1e-8
#: Numbers that one forward table may have, whatever the number of languages.
TABLE_CELLS = 4_000_000
FILTER_BITS = 20
BASE = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(c.isalpha() for c in w)]


class Vocabulary:
    """The pieces, numbered; number 0 is a letter that is no piece."""

    def __init__(self, pieces: Iterable[str]):
        self.pieces = ["", *sorted({p for p in pieces if p and p == p.lower() and WORD.fullmatch(p.removeprefix(MARK) or "a")})]
        self.number = {p: i for i, p in enumerate(self.pieces) if i}
        self.longest = max(map(len, self.pieces))
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(self.pieces[1:], start=1):
            by_length.setdefault(len(p), []).append(i)
        self.tables = {}
        for length, own in by_length.items():
            points = np.frombuffer("".join(self.pieces[i] for i in own).encode("utf-32-le"), "<u4").reshape(-1, length)
            hashes = np.zeros(len(own), np.uint64)
            for column in points.T:
                hashes = hashes * BASE + column.astype(np.uint64) * MIX
            order = np.argsort(hashes)
            present = np.zeros(1 << FILTER_BITS, bool)
            present[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.tables[length] = (hashes[order], np.array(own, np.int64)[order], present)

    def matches(self, words: list[str]) -> tuple[np.ndarray, list[list[tuple[np.ndarray, np.ndarray]]]]:
        """Lengths of the marked words, and for each end and piece length (words, pieces) that match there."""
        points = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le"), "<u4").astype(np.uint64) * MIX
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(points)) - starts[word]
        left = lengths[word] - place
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(int(lengths.max()) + 1)]
        hashes = np.zeros(len(points), np.uint64)
        for k in range(1, min(self.longest, int(lengths.max())) + 1):
            hashes = hashes[: len(points) - k + 1] * BASE + points[k - 1 :]
            whole = left[: len(hashes)] >= k
            if k in self.tables:
                table, numbers, present = self.tables[k]
                at = np.flatnonzero(whole & present[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                where = np.minimum(np.searchsorted(table, hashes[at]), len(table) - 1)
                same = table[where] == hashes[at]
                at, pieces = at[same], numbers[where[same]]
            else:
                at, pieces = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if k == 1:  # letters that are no piece
                none = np.ones(len(points), bool)
                none[at] = False
                extra = np.flatnonzero(none)
                at, pieces = np.concatenate([at, extra]), np.concatenate([pieces, np.zeros(len(extra), np.int64)])
            ends = place[at] + k
            order = np.argsort(ends, kind="stable")
            at, pieces, ends = at[order], pieces[order], ends[order]
            bounds = np.searchsorted(ends, np.arange(len(found) + 1))
            for j in range(k, len(found)):
                a, b = bounds[j], bounds[j + 1]
                found[j].append((word[at[a:b]], pieces[a:b]))
        return lengths, found

    def log_chances(self, words: list[str], chance: np.ndarray) -> np.ndarray:
        """[word, language]: the log of each word's probability, over all its segmentations; ``chance`` is [piece, language]."""
        out = np.empty((len(words), chance.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        short.sort(key=lambda i: len(words[i]))
        step = max(64, TABLE_CELLS // ((LONG + 2) * chance.shape[1]))
        for a in range(0, len(short), step):
            part = short[a : a + step]
            out[part] = self._log_chances_of_short([words[i] for i in part], chance)
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._log_chance_of_long(MARK + w, chance)
        return out

    def _log_chances_of_short(self, words: list[str], chance: np.ndarray) -> np.ndarray:
        """The forward sums of all ``words`` at once; the places that later ones need are scaled now and then."""
        lengths, found = self.matches(words)
        alpha = np.zeros((len(words), len(found), chance.shape[1]))
        alpha[:, 0] = 1
        scale = np.zeros((len(words), chance.shape[1]))
        for j in range(1, len(found)):
            for k, (word, pieces) in enumerate(found[j], start=1):
                if len(word):
                    alpha[word, j] += alpha[word, j - k] * chance[pieces]
            if j % RESCALED == 0:
                peak = np.where(alpha[:, j] > 0, alpha[:, j], 1.0)  # words that have ended stay as they are
                alpha[:, max(0, j - self.longest) : j + 1] /= peak[:, None]
                scale += np.log(peak)
        return np.log(alpha[np.arange(len(words)), lengths]) + scale

    def _log_chance_of_long(self, word: str, chance: np.ndarray) -> np.ndarray:
        """The same sum for one word, scaled at every place, in the memory of its longest piece."""
        last = [np.ones(chance.shape[1])]
        total = np.zeros(chance.shape[1])
        for j in range(1, len(word) + 1):
            now = np.zeros(chance.shape[1])
            for k in range(1, min(j, self.longest) + 1):
                piece = self.number.get(word[j - k : j], 0 if k == 1 else None)
                if piece is not None:
                    now += last[-k] * chance[piece]
            total += np.log(now)
            last = [x / now for x in [*last[-self.longest :], now]]
        return total

    def expected_uses(self, words: list[str], counts: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """[piece]: expected uses in ``words`` of up to ``LONG`` letters, each ``counts`` times, under ``chance`` [piece]."""
        uses, log_chance = np.zeros(len(self.pieces)), np.log(chance)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        step = TABLE_CELLS // (LONG + 2)
        for a in range(0, len(order), step):
            part = order[a : a + step]
            lengths, found = self.matches([words[i] for i in part])
            rows = np.arange(len(part))
            alpha, beta = (np.full((len(part), len(found)), -np.inf) for _ in range(2))  # logs
            alpha[:, 0], beta[rows, lengths] = 0.0, 0.0
            for j in range(1, len(found)):
                for k, (word, pieces) in enumerate(found[j], start=1):
                    if len(word):
                        alpha[word, j] = np.logaddexp(alpha[word, j], alpha[word, j - k] + log_chance[pieces])
            total, weight = alpha[rows, lengths], counts[part]
            for j in range(len(found) - 1, 0, -1):
                for k, (word, pieces) in enumerate(found[j], start=1):
                    if len(word):
                        rest = log_chance[pieces] + beta[word, j]
                        beta[word, j - k] = np.logaddexp(beta[word, j - k], rest)
                        uses += np.bincount(pieces, np.exp(alpha[word, j - k] + rest - total[word]) * weight[word], len(uses))
        return uses


@functools.cache
def vocabulary(file: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return Vocabulary(model.id_to_piece(i) for i in ids)


def smoothed(uses: np.ndarray) -> np.ndarray:
    """[piece, language] probabilities; what a language does not use is equally improbable in all of them."""
    uses = uses.copy()
    uses[0] = 0  # the letter that is no piece
    share = uses / np.maximum(uses.sum(axis=0), 1e-300)
    return (share + UNSEEN) / (1 + UNSEEN * len(uses))


def held_out() -> object:
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of 5."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def _usable(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").filter(~held_out())


def languages_of(docs: DataFrame) -> list[tuple[str, int]]:
    """The languages to learn, by name, with their numbers of documents: a row for each language."""
    return [(r["lang"], r["count"]) for r in _usable(docs).groupBy("lang").count().orderBy("lang").collect()]


def learn(docs: DataFrame, languages: list[tuple[str, int]], file: str, docs_per_language: int = DOCS_PER_LANGUAGE, rounds: int = ROUNDS) -> np.ndarray:
    """[piece, language] probabilities of ``languages`` (name, number of documents)."""
    names = [name for name, _ in languages]
    shares = F.create_map(*[F.lit(x) for name, n in languages for x in (name, min(1.0, docs_per_language / n))])
    at = F.create_map(*[F.lit(x) for pair in zip(names, range(len(names)), strict=True) for x in pair])
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = _usable(docs).filter(part < shares[F.col("lang")]).select(at[F.col("lang")].alias("lang"), "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, Counter] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # a word of more than LONG letters counts as several
                found.setdefault(lang, Counter()).update(w[k : k + LONG] for w in words_of(text) for k in range(0, len(w), LONG))
            rows = [(lang, w, n) for lang, own in found.items() for w, n in own.items()]
            langs, words, n = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.int32()), pa.array(words, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    counted = cut(sample.mapInArrow(count, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    size, context = len(vocabulary(file).pieces), docs.sparkSession.sparkContext
    chance = np.full((size, len(names)), 1.0 / size)
    for _ in range(rounds):
        now = context.broadcast(chance)

        def expect(batches: Iterable[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            model, total = vocabulary(file), np.zeros(now.value.shape)
            for batch in batches:
                langs, words, n = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object), batch.column(2).to_numpy()
                for lang in np.unique(langs):
                    own = langs == lang
                    total[:, lang] += model.expected_uses(words[own].tolist(), n[own].astype(float), now.value[:, lang])
            pieces, langs = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), pa.array(langs, pa.int32()), pa.array(total[pieces, langs])], ["piece", "lang", "uses"])

        uses = np.zeros(chance.shape)
        rows = counted.mapInArrow(expect, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
        found = rows.toArrow()  # a row for each piece and language at most
        uses[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["uses"].to_numpy()
        chance = smoothed(uses)
        now.unpersist()
    return chance


def _scored(rows: DataFrame, languages: list[str], chance: np.ndarray, file: str) -> DataFrame:
    """``rows`` (.., body, best, top, mass) with ``languages`` taken into account.

    ``best`` is the most probable language so far, ``top`` the log of the text's probability under it, and ``mass``
    the sum of the probabilities under all languages so far, as a multiple of that one. They are null at first.
    """
    model = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(chance))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(file)
        for batch in batches:
            number: dict[str, int] = {}
            texts = []
            bodies = batch.column(batch.schema.names.index("body"))
            for i in range(len(bodies)):
                texts.append(np.array([number.setdefault(w, len(number)) for w in words_of(bodies[i].as_py())], np.int64))
            logs = known.log_chances(list(number), model.value) if number else None
            found = zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("best", "top", "mass")), strict=True)
            out = []
            for own, (best, top, mass) in zip(texts, found, strict=True):
                if len(own):
                    total = logs[own].sum(axis=0)
                    k = int(total.argmax())
                    sum_ = float(np.exp(np.maximum(total - total[k], -700)).sum())
                    if best is None:
                        best, top, mass = languages[k], float(total[k]), sum_
                    elif total[k] > top:
                        best, top, mass = languages[k], float(total[k]), sum_ + mass * float(np.exp(max(top - total[k], -700)))
                    else:
                        mass += sum_ * float(np.exp(max(total[k] - top, -700)))
                out.append((best, top, mass))
            kinds = (pa.string(), pa.float64(), pa.float64())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *columns], batch.schema.names)

    return rows.mapInArrow(score, rows.schema)


def identify(docs: DataFrame, vocabulary_file: str | None = None, docs_per_language: int = DOCS_PER_LANGUAGE, at_once: int = LANGUAGES_AT_ONCE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang), from its text alone."""
    file = vocabulary_file or tokens.vocabulary("piece_bpe_32k.model")
    languages = languages_of(docs)
    nothing = F.lit(None)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("body"), nothing.cast("string").alias("best"), nothing.cast("double").alias("top"), nothing.cast("double").alias("mass"))
    for a in range(0, len(languages), at_once):
        block = languages[a : a + at_once]
        rows = _scored(rows if a == 0 else stored(rows), [name for name, _ in block], learn(docs, block, file, docs_per_language), file)
    return rows.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        F.coalesce("best", F.lit("und")).alias("lang_pred"),
        F.coalesce(1 / F.col("mass"), F.lit(0.0)).alias("score"),
    )
