"""The language of documents and of lines that depart from it: sparse multinomial logistic regression on TF-IDF character
n-grams, trained by follow-the-regularised-leader with elastic-net penalties and calibrated by a temperature."""

from __future__ import annotations

import html
import re
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed n-gram buckets, and the lengths of n-grams (of letters, with a mark at either end of a word).
BUCKETS, ORDERS = 1 << 16, (1, 2, 3, 4)

#: A line counts from so many characters on, if at least this share of them, as repaired and without outer blanks, are letters
#: of words.
LINE_CHARS, LETTER_SHARE = 80, 0.5

#: Longer tokens in an alphabet that parts words by blanks are no words.
WORD_CHARS = 40

#: Tokens kept with their scores, in a cache that starts anew when full.
CACHED_TOKENS = 150_000

#: Three-letter codes of the languages that may occur (ISO 639-2, both kinds; fixed values).
ISO3 = {
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it", "nld": "nl", "dut": "nl",
    "swe": "sv", "pol": "pl", "tur": "tr", "rus": "ru", "ukr": "uk", "ell": "el", "gre": "el", "jpn": "ja",
}

_letters = re.compile(r"[^\W\d_]+")
_unspaced = re.compile("[฀-໿぀-ヿ㐀-鿿가-힯ｦ-ﾟ]")
_misread = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™�]")


def _windows_bytes() -> dict[int, int]:
    """Characters by which Windows-1252 shows the bytes 0x80 to 0xff, where it has any, else Latin-1's."""
    table = {}
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode("cp1252"))] = b
        except UnicodeDecodeError:
            pass
        table.setdefault(b, b)
    return table


#: A byte that Windows-1252 does not have is lost as U+FFFD; 0x81 stands for it, which leaves its neighbours in their alphabet.
_TO_BYTE = _windows_bytes() | {0xFFFD: 0x81}


def reread(text: str) -> str:
    """UTF-8 that was read as Windows-1252, read as UTF-8 again; the text itself where it does not look so."""
    if not _misread.search(text):
        return text
    raw = bytes(_TO_BYTE.get(ord(c), 63 if ord(c) > 127 else ord(c)) for c in text)
    again = raw.decode("utf8", "replace")
    high = sum(b > 127 for b in raw)
    return again if again.count("�") * 4 <= high and len(again) < len(text) else text


def grams(word: str) -> list[int]:
    marked = f"\x02{word}\x03"
    return [crc32(marked[i : i + n].encode("utf8", "replace")) % BUCKETS for n in ORDERS for i in range(len(marked) - n + 1)]


def words_of(token: str) -> list[str]:
    """Words (letters, lower case) of a token without blanks; none where it is too long for a word."""
    if len(token) > WORD_CHARS and not _unspaced.search(token):
        return []
    return _letters.findall(token.lower())


def tokens_of(line: str) -> list[str]:
    return reread(html.unescape(line) if "&" in line else line).split()


@dataclass
class Model:
    codes: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0

    def features(self, line: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and TF-IDF values (summing to SCALE) of a line."""
        found = [b for t in tokens_of(line) for w in words_of(t) for b in grams(w)]
        buckets, tf = np.unique(np.array(found, dtype=np.int64), return_counts=True)
        value = tf * self.idf[buckets]
        return buckets, value * (SCALE / max(value.sum(), 1e-9))


#: Sum of a line's TF-IDF values, whatever its length.
SCALE = 30.0


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(lines: list[str], labels: list[str], codes: list[str], idf: np.ndarray, epochs: int = 8, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 7) -> Model:
    """FTRL-proximal over the lines in a fixed random order; weights within l1 of nothing are zero. The lines' features, which take many times their
    room, wait in a file."""
    model, k = Model(codes, idf), len(codes)
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    zb, nb = np.zeros(k), np.zeros(k)
    index = {c: i for i, c in enumerate(codes)}
    data, end = [], 0
    store = tempfile.TemporaryFile()
    for line, label in zip(lines, labels):
        if label in index:
            buckets, value = model.features(line)
            data.append((end, len(buckets), index[label]))
            end += store.write(value.astype("<f8").tobytes() + buckets.astype("<u2").tobytes())

    def weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(data)):
            start, size, label = data[i]
            if not size:
                continue
            store.seek(start)
            raw = store.read(10 * size)
            value, buckets = np.frombuffer(raw, "<f8", size), np.frombuffer(raw, "<u2", size, 8 * size)
            w, b = weights(z[buckets], n[buckets], l1), weights(zb, nb, 0.0)
            error = _softmax(value @ w + b)
            error[label] -= 1.0
            g = value[:, None] * error[None, :]
            z[buckets] += g - (np.sqrt(n[buckets] + g * g) - np.sqrt(n[buckets])) / alpha * w
            n[buckets] += g * g
            zb += error - (np.sqrt(nb + error * error) - np.sqrt(nb)) / alpha * b
            nb += error * error
    store.close()
    model.weights, model.bias = weights(z, n, l1), weights(zb, nb, 0.0)
    return model


def line_scores(model: Model, line: str) -> np.ndarray:
    buckets, value = model.features(line)
    return value @ model.weights[buckets] + model.bias


#: Lengths of the cuts of held-out lines on which confidences are calibrated; the last stands for whole lines. Whole lines alone are told apart
#: without error, which leaves the temperature undetermined.
CUTS = (6, 12, 24, 48, 96, 1 << 30)

#: Temperatures tried.
GRID = np.exp(np.linspace(np.log(0.05), np.log(20), 121))


def _losses(scores: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Negative log-likelihood of the truth under each temperature of GRID, summed."""
    return np.array([-np.log(np.maximum(_softmax(scores / g)[np.arange(len(truth)), truth], 1e-12)).sum() for g in GRID])


def temperature_of(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of GRID under which the truth is likeliest."""
    return float(GRID[int(np.argmin(_losses(scores, truth)))])


def _binned(chance: np.ndarray, truth: np.ndarray, bins: int = 15) -> np.ndarray:
    """Sum of confidences, right answers and answers per bin of confidence."""
    sure, right = chance.max(1), chance.argmax(1) == truth
    at = np.minimum((sure * bins).astype(int), bins - 1)
    return np.array([np.bincount(at, x, bins) for x in (sure, right, np.ones(len(at)))])


def _gap(binned: np.ndarray) -> float:
    sure, right, n = binned
    return float(np.abs(sure - right).sum() / max(n.sum(), 1))


def calibration_error(chance: np.ndarray, truth: np.ndarray, bins: int = 15) -> float:
    """Expected calibration error: mean difference of confidence and accuracy over bins of confidence, weighted by their size."""
    return _gap(_binned(chance, truth, bins))


def _fit_fold(lines: list[str], labels: list[str], codes: list[str], idf: np.ndarray, fold: int, folds: int) -> tuple[np.ndarray, bytes | None]:
    """From a cut of every length of each line of a fold, by the model of the other folds: losses under each temperature of GRID in two halves of the
    lines, bins of the first half under each of them, right answers and answers on whole lines; these are sums, so many numbers whatever the lines. Of
    fold number `folds`, which has no lines: bias and weights of the model of all lines."""
    model = fit([x for i, x in enumerate(lines) if i % folds != fold or fold == folds], [y for i, y in enumerate(labels) if i % folds != fold or fold == folds], codes, idf)
    if fold == folds:
        return model.bias, model.weights.astype("<f8").tobytes()
    where, scores = np.random.default_rng(fold), []
    for line in lines[fold::folds]:
        for size in CUTS:
            start = int(where.integers(0, max(0, len(line) - size) + 1))
            scores.append(line_scores(model, line[start : start + size]))
    s, t = np.array(scores), np.repeat([codes.index(label) for label in labels[fold::folds]], len(CUTS))
    half, uncut = np.arange(len(t)) // len(CUTS) % 2 == 0, np.arange(len(t)) % len(CUTS) == len(CUTS) - 1
    bins = np.array([_binned(_softmax(s[half] / g), t[half]) for g in GRID])
    return np.concatenate([_losses(s[half], t[half]), _losses(s[~half], t[~half]), bins.ravel(), [(s.argmax(1) == t)[uncut].sum(), uncut.sum()]]), None


def calibrated(samples: DataFrame, codes: list[str], idf: np.ndarray, folds: int = 5) -> tuple[Model, dict[str, float]]:
    """The model of all lines of samples (lang_code, sample_text) with the temperature that suits the held-out cuts of `folds` folds best, and a
    report: accuracy of whole lines, and calibration error of one half of the cuts under the temperature of the other half; of fewer than ten lines a
    fold no temperature. The folds and the model of all lines are fitted as tasks, to each of which all lines are sent; the driver gets weights and sums."""
    shared = samples.sparkSession.sparkContext.broadcast((codes, idf))

    def fitted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in source for row in zip(*(column.to_pylist() for column in batch.columns))]
        if not rows:
            return
        fold = rows[0][0]
        if fold < folds and len(rows) < 10 * folds:
            return
        rows.sort(key=lambda row: row[1:])
        numbers, weights = _fit_fold([row[2] for row in rows], [row[3] for row in rows], *shared.value, fold, folds)
        yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([numbers.tolist()], pa.list_(pa.float64())), pa.array([weights], pa.binary())], ["fold", "numbers", "weights"])

    every = samples.select(F.explode(F.array(*map(F.lit, range(folds + 1)))).alias("fold"), F.xxhash64("sample_text", "lang_code").alias("place"), "sample_text", "lang_code")
    rows = every.repartitionById(folds + 1, F.col("fold")).mapInArrow(fitted, "fold int, numbers array<double>, weights binary").collect()
    if not rows:
        return fit([], [], codes, idf), {"accuracy": float("nan"), "calibration_error": float("nan")}
    whole = next(r for r in rows if r["fold"] == folds)
    model = Model(codes, idf, np.frombuffer(whole["weights"], "<f8").reshape(BUCKETS, len(codes)), np.array(whole["numbers"]))
    if len(rows) == 1:
        return model, {"accuracy": float("nan"), "calibration_error": float("nan")}
    first, second, bins, (right, lines) = np.split(sum(np.array(r["numbers"]) for r in sorted(rows) if r["fold"] < folds), np.cumsum([len(GRID), len(GRID), len(GRID) * 45]))
    model.temperature = float(GRID[int(np.argmin(first + second))])
    return model, {"accuracy": float(right / lines), "calibration_error": _gap(bins.reshape(len(GRID), 3, -1)[int(np.argmin(second))])}


class TokenTable:
    """Scores of tokens as rows of one matrix: class scores, TF-IDF mass and letters; so that a line's features are a sum of
    rows. Starts anew when full, between documents."""

    def __init__(self, model: Model) -> None:
        self.k = len(model.codes)
        self.weights = model.weights.astype(np.float32)
        self.idf = model.idf.astype(np.float32)
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((CACHED_TOKENS + 65_536, self.k + 2), dtype=np.float32) if not hasattr(self, "rows") else self.rows

    def add(self, token: str) -> int:
        words = words_of(token)
        i = len(self.index)
        if i >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        row = self.rows[i]
        row[:] = 0
        if words:
            buckets = np.array([b for w in words for b in grams(w)], dtype=np.int64)
            idf = self.idf[buckets]
            row[: self.k] = idf @ self.weights[buckets]
            row[self.k] = idf.sum()
            row[self.k + 1] = sum(map(len, words))
        self.index[token] = i
        return i


_tables: dict[str, TokenTable] = {}


def _counted(text: str) -> list[tuple[int, int, str]]:
    """(line number from 1, characters, line) of the lines long enough to count."""
    found = []
    for number, line in enumerate(text.split("\n"), 1):
        if len(line) >= LINE_CHARS:
            size = len(line) - line.endswith("\r")
            if size >= LINE_CHARS:
                found.append((number, size, line))
    return found


def _reader(text: str) -> Callable[[str], list[str]]:
    """How lines of this text are cut into tokens: the repairs are tried only where the text calls for them."""
    return tokens_of if "&" in text or _misread.search(text) else str.split


def _classify(shared: Broadcast, every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document row: line_no 0 with the language of the document, and each counted line in another one. With `every`, line_no 0 also of the
    documents without a counted line."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, name = shared.value
        if name not in _tables:
            _tables.clear()
            _tables[name] = TokenTable(model)
        table, k = _tables[name], len(model.codes)
        docs, numbers, sizes, widths, sums, flat, starts = [], [], [], [], [], [], []
        judged_docs: set[int] = set()

        def reduce_tokens() -> None:
            """Sums of the token rows of each line so far; afterwards the table may start anew."""
            if flat:
                sums.append(np.add.reduceat(table.rows[np.array(flat, dtype=np.int64)], np.array(starts), axis=0))
                flat.clear(), starts.clear()
            if len(table.index) >= CACHED_TOKENS:
                table.reset()

        def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
            reduce_tokens()
            rows, size, doc = np.concatenate(sums), np.array(sizes), np.array(docs)
            natural = rows[:, k + 1] >= LETTER_SHARE * np.array(widths)
            rows, size, doc, line = rows[natural], size[natural], doc[natural], np.array(numbers)[natural]
            docs.clear(), numbers.clear(), sizes.clear(), widths.clear(), sums.clear()
            scores = rows[:, :k] * (SCALE / np.maximum(rows[:, k : k + 1], 1e-9)) + model.bias
            chance = _softmax(scores.astype(np.float64) / model.temperature)
            best = chance.argmax(1)
            sure = chance[np.arange(len(best)), best]
            seen, at = np.unique(doc, return_inverse=True)
            judged_docs.update(seen.tolist())
            chars, mass = np.zeros((len(seen), k)), np.zeros((len(seen), k))
            np.add.at(chars, (at, best), size)
            np.add.at(mass, (at, best), size * sure)
            main = chars.argmax(1)
            rank = np.arange(len(seen))
            apart = np.flatnonzero(best != main[at])
            which = pa.array(np.concatenate([seen, doc[apart]]).astype(np.int64))
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(which), batch.column(2).take(which), pa.array(np.concatenate([np.zeros(len(seen)), line[apart]]).astype(np.int32)),
                    pa.array(np.concatenate([main, best[apart]]).astype(np.int32)), pa.array(np.concatenate([mass[rank, main] / np.maximum(chars[rank, main], 1), sure[apart]])),
                ],
                ["row_no", "label", "line_no", "code_no", "confidence"],
            )

        def of_words(text: str | None) -> tuple[int | None, float | None]:
            """Language and confidence of all words of a text, read as one line."""
            total, read = np.zeros(k + 2), _reader(text or "")
            for line in (text or "").split("\n"):
                if at := [j if (j := table.index.get(t)) is not None else table.add(t) for t in read(line)]:
                    total += table.rows[at].sum(axis=0, dtype=np.float64)
                if len(table.index) >= CACHED_TOKENS:
                    table.reset()
            if not total[k + 1]:
                return None, None
            chance = _softmax((total[:k] * (SCALE / max(total[k], 1e-9)) + model.bias) / model.temperature)
            return int(chance.argmax()), float(chance.max())

        def others(batch: pa.RecordBatch) -> pa.RecordBatch:
            rest = [i for i in range(batch.num_rows) if i not in judged_docs]
            found = [of_words(batch.column(1)[i].as_py()) for i in rest]
            which = pa.array(rest, pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(which), batch.column(2).take(which), pa.array([0] * len(rest), pa.int32()),
                    pa.array([code for code, _ in found], pa.int32()), pa.array([sure for _, sure in found], pa.float64()),
                ],
                ["row_no", "label", "line_no", "code_no", "confidence"],
            )

        for batch in source:
            judged_docs.clear()
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                lines = _counted(text) if text else ()
                if not lines:
                    continue
                read = _reader(text)
                for number, size, line in lines:
                    tokens = read(line)
                    if not tokens:
                        continue
                    get, add = table.index.get, table.add
                    starts.append(len(flat))
                    flat.extend([j if (j := get(t)) is not None else add(t) for t in tokens])
                    docs.append(i)
                    numbers.append(number)
                    sizes.append(size)
                    widths.append(sum(map(len, tokens)) + len(tokens) - 1)
                    if len(flat) > 300_000 or len(table.index) >= CACHED_TOKENS:
                        reduce_tokens()
                if len(docs) > 50_000:
                    yield judged(batch)
            if docs:
                yield judged(batch)
            if every:
                yield others(batch)

    return batches


def _frequencies(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, n: documents of a task in whose counted lines an n-gram occurs; bucket -1 has the documents."""
    known: dict[str, np.ndarray] = {}
    n, documents = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in source:
        for text in batch.column(0):
            text = text.as_py()
            if not text:
                continue
            read = _reader(text)
            tokens = {t for _, _, line in _counted(text) for t in read(line)}
            if not tokens:
                continue
            documents += 1
            found = []
            for t in tokens:
                buckets = known.get(t)
                if buckets is None:
                    buckets = np.array([b for w in words_of(t) for b in grams(w)], dtype=np.int32)
                    if len(known) >= CACHED_TOKENS:
                        known.clear()
                    known[t] = buckets
                found.append(buckets)
            mark = np.zeros(BUCKETS, dtype=bool)
            mark[np.concatenate(found)] = True
            n += mark
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(n[used], documents))], ["bucket", "n"])


def corpus_idf(documents: DataFrame, text: str = "text") -> np.ndarray:
    """ln((1 + N) / (1 + n)) + 1 of every bucket over the counted lines of all N documents. What reaches the driver is one
    number per bucket, whatever the corpus."""
    counts = documents.select(text).mapInArrow(_frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    n = np.zeros(BUCKETS + 1)
    for bucket, count in counts.toPandas().itertuples(index=False):
        n[bucket] = count
    return np.log((1 + n[-1]) / (1 + n[:-1])) + 1


def train(samples: DataFrame, idf: np.ndarray, codes: list[str]) -> tuple[Model, dict[str, float]]:
    """The model fitted on all labelled lines (lang_code, sample_text), and its held-out report. Repeated lines count once; lines without text or
    with a code that is not in `codes` say nothing."""
    return calibrated(samples.filter(F.col("sample_text").isNotNull() & F.col("lang_code").isin(codes)).select("lang_code", "sample_text").distinct(), codes, idf)


def label_code(label: Column, codes: DataFrame) -> Column:
    """The language of a label in any notation: two- or three-letter code, with or without a region, or the language's title;
    null where it names none of `codes`, a fixed small table."""
    plain = F.lower(F.btrim(label))
    base = F.regexp_extract(plain, r"^([a-z]{2,3})([-_].*)?$", 1)
    names: dict[str, str] = {}
    for code, title in codes.select("lang_code", "lang_title").filter("lang_code is not null").distinct().collect():
        names |= {code.lower(): code, (title or code).strip().lower(): code}
    names |= {three: two for three, two in ISO3.items() if two in names.values()}
    if not names:
        return F.lit(None).cast("string")
    lookup = F.create_map(*(F.lit(x) for pair in sorted(names.items()) for x in pair))
    return F.coalesce(F.try_element_at(lookup, plain), F.try_element_at(lookup, base))


def document_languages(documents: DataFrame, samples: DataFrame, codes: DataFrame, every: bool = False) -> DataFrame:
    """doc_id, line_no, lang_code, confidence, relabelled. line_no 0: the language of the document, the one with most characters
    in its counted lines (the first by code on a tie), with the mean confidence of those characters; relabelled says whether
    the label is missing, unusable or another language. Other rows: each counted line in another language than its document.

    One pass over the corpus counts documents per n-gram, a second one classifies; neither moves texts between tasks.
    Null, empty and blank texts, and texts without a counted line, give no row; with `every` these documents too have their row at line_no 0: the
    language of all their words, read as one line, with its confidence, or nulls where there is no word. Repeated rows each give their rows.
    Very long lines are read whole. An empty table, of documents, codes or samples, gives an empty result; other columns are not
    read."""
    names = sorted(r["lang_code"] for r in codes.filter("lang_code is not null").select("lang_code").distinct().collect())
    if not names or samples.filter(F.col("sample_text").isNotNull() & F.col("lang_code").isin(names)).isEmpty():
        return documents.limit(0).select("doc_id", F.lit(0).alias("line_no"), F.lit("").alias("lang_code"), F.lit(0.0).alias("confidence"), F.lit(True).alias("relabelled"))
    idf = corpus_idf(documents)
    model, _ = train(samples, idf, names)
    shared = documents.sparkSession.sparkContext.broadcast((model, f"{crc32(idf.tobytes())}-{crc32(model.weights.tobytes())}"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(F.col("doc_id").alias("row_no"), "text", F.col("lang").cast("string").alias("label")).mapInArrow(
        _classify(shared, every), f"row_no {kind}, label string, line_no int, code_no int, confidence double"
    )
    code = F.get(F.array(*map(F.lit, names)), F.col("code_no"))
    right = F.coalesce(label_code(F.col("label"), codes) == code, F.lit(False)) & (F.col("line_no") == 0)
    return rows.select(F.col("row_no").alias("doc_id"), "line_no", code.alias("lang_code"), "confidence", (code.isNotNull() & ~right).alias("relabelled"))
