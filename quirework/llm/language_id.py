"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit, a binary n-gram classifier (the log odds of hashed byte n-grams
between the languages whose codeword has the bit and those whose hasn't) says how surely the bit is set.
Loss-weighted decoding takes the language whose codeword has the least logistic loss over all bits, and
flags a text as ambiguous if the runner-up is close.

The classifiers learn from at most ``most_documents`` labelled documents of each language, chosen by a hash of
their id: this bounded sample is counted on the executors, and only n-gram counts (2 ** BITS for each language)
come to the driver. Prediction reads whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, not ambiguous; a training row
with null language, text or id is left out; without any labelled row all texts are ``und``; with one
language it is the prediction for all texts with letters; repeated rows give repeated predictions; other
columns are ignored (``filter_documents`` keeps them).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .shared import prepare_workers, texts_as_bytes

UND = "und"
#: Hash bits of n-grams; byte lengths of n-grams; labelled documents for each language at most.
BITS, ORDERS, MOST_DOCUMENTS = 15, (2, 3, 4), 3000
#: Less than this difference of the mean loss between the two best codewords is ambiguous.
AMBIGUOUS = 0.02
#: Letters and bytes of non-ASCII characters stay (A-Z as a-z), all else is a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
STEP = 1 << 18


def folded(text: bytes) -> bytes:
    """Words of letters between single spaces, with one at either end."""
    return b" " + b" ".join(text.translate(FOLD).split()) + b" "


def hashes(data: np.ndarray) -> list[np.ndarray]:
    """For each order, the hash of the n-gram that starts at each byte."""
    wide, out = data.astype(np.uint32), []
    for n in ORDERS:
        m = len(wide) - n + 1
        if m <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        h = np.full(m, np.uint32(0x9E3779B1 * n & 0xFFFFFFFF))
        for k in range(n):
            h = (h ^ wide[k : k + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)).astype(np.int64))
    return out


def has_letter(text: bytes) -> bool:
    if any(97 <= c <= 122 for c in set(text[:64].translate(FOLD))):
        return True
    rest = text.translate(FOLD).replace(b" ", b"")
    return bool(rest) and (any(97 <= c <= 122 for c in set(rest)) or any(map(str.isalpha, text.decode("utf-8", "ignore"))))


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language; columns differ from each other and each other's complement.

    Up to six languages get the exhaustive code, more get a random one of 10 log2(k) bits (of some, the one with
    the largest least distance).
    """
    if languages < 2:
        return np.ones((languages, 1), np.int8)
    if languages <= 6:
        rest = range(1, languages)
        sets = [set(c) for n in range(1, languages) for c in combinations(rest, n)]
        return np.array([[1 if k in s else -1 for s in sets] for k in range(languages)], np.int8)
    random, best, least = np.random.default_rng(5), None, -1
    bits = int(np.ceil(10 * np.log2(languages)))
    for _ in range(200):
        code = random.choice(np.array([-1, 1], np.int8), (languages, bits))
        if (np.abs(code.sum(0, dtype=int)) == languages).any():
            continue
        apart = min(int((a != b).sum()) for a, b in combinations(code, 2))
        if apart > least:
            best, least = code, apart
    return best if best is not None else 2 * np.eye(languages, dtype=np.int8) - 1


class Model:
    """Weights of the binary classifiers, and the codewords."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True) if len(languages) else counts
        columns = []
        for bit in self.code.T:
            one, zero = (share[bit == v].mean(0) if (bit == v).any() else np.full(share.shape[1], 1.0) for v in (1, -1))
            columns.append(np.log(one / zero))
        self.weights = np.ascontiguousarray(np.array(columns, np.float32).T) if columns else np.zeros((1 << BITS, 1), np.float32)

    def margins(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(mean log odds of each bit, number of n-grams) of each text."""
        out, n = np.zeros((len(texts), self.weights.shape[1])), np.zeros(len(texts), np.int64)
        parts = [folded(t) for t in texts]
        begin = 0
        while begin < len(parts):
            end, size = begin, 0
            while end < len(parts) and (end == begin or size + len(parts[end]) <= STEP):
                size += len(parts[end])
                end += 1
            group = parts[begin:end]
            data = np.frombuffer(b"".join(group), np.uint8)
            stops = np.cumsum([len(p) for p in group])
            starts = stops - [len(p) for p in group]
            if len(data) > STEP:  # one text, as a group of several ends before the step: in pieces that overlap by an n-gram
                for order, size in enumerate(ORDERS):
                    for at in range(0, len(data), STEP):
                        h = hashes(data[at : at + STEP + size - 1])[order][:STEP]
                        out[begin] += self.weights[h].sum(0, dtype=np.float64)
                        n[begin] += len(h)
            else:
                for h, size in zip(hashes(data), ORDERS):
                    if not len(h):
                        continue
                    lasts = np.maximum(stops - size + 1, starts)
                    running = np.zeros((len(h) + 1, out.shape[1]))
                    np.cumsum(self.weights[h], axis=0, dtype=np.float64, out=running[1:])
                    upto = np.minimum(lasts, len(h))
                    out[begin:end] += running[upto] - running[np.minimum(starts, len(h))]
                    n[begin:end] += np.maximum(upto - starts, 0)
            begin = end
        return out / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score from 0 to 1, ambiguous) of each text."""
        letters = np.array([has_letter(t) for t in texts], bool)
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        margin, n = self.margins(texts)
        scaled = margin[:, None, :] * self.code[None, :, :] * 4
        loss = np.logaddexp(0, -scaled).mean(2)
        best = loss.argmin(1)
        first = np.take_along_axis(loss, best[:, None], 1)
        evidence = np.exp(-(loss - first) * np.minimum(n, 400)[:, None] * 0.25)
        score = np.round(1 / evidence.sum(1), 6)
        rest = loss.copy()
        np.put_along_axis(rest, best[:, None], np.inf, 1)
        ambiguous = rest.min(1) - first[:, 0] < AMBIGUOUS
        names = [self.languages[k] if ok else UND for k, ok in zip(best.tolist(), letters.tolist())]
        return names, np.where(letters, score, 0.0), ambiguous & letters


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most_documents: int = MOST_DOCUMENTS) -> Model:
    """Learns from labelled rows, at most about ``most_documents`` of each language (those with the least hashes of their ids)."""
    prepare_workers(rows.sparkSession)
    known = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"))
    known = known.where("text is not null and lang is not null and id is not null")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 1 << BITS)))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, most_documents / sizes[lang]))))
    sample = known.where(place < share[F.col("lang")])

    def run(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(texts_as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                counts = total.setdefault(lang, np.zeros(1 << BITS, np.int64))
                data = np.frombuffer(folded(text), np.uint8)
                for order, size in enumerate(ORDERS):
                    for at in range(0, len(data), STEP):
                        counts += np.bincount(hashes(data[at : at + STEP + size - 1])[order][:STEP], minlength=1 << BITS)
        for lang, counts in total.items():
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(counts[found])], ["lang", "h", "n"])

    made = sample.select("text", "lang").mapInArrow(run, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    # at most 2 ** BITS rows for each language
    table = np.zeros((len(languages), 1 << BITS))
    for r in made.toPandas().itertuples(index=False):
        table[languages.index(r.lang), r.h] = r.n
    return Model(languages, table)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of each row."""
    spark = docs.sparkSession
    prepare_workers(spark)
    # a model's size depends on its languages only
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names, score, ambiguous = sent.value.predict(texts_as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def remainder(column, of: int):
    """crc32 of the id as text, modulo ``of``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % of


def held_out_prediction(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: learnt from rows whose id's crc32 modulo 5 isn't 0."""
    model = fit(docs.where(remainder("doc_id", 5) != 0))
    return predict(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def filter_documents(docs: DataFrame, model: Model, text_col: str = "text", reject_ambiguous: bool = False) -> DataFrame:
    """The rows with a language, with all their columns; if asked for, without ambiguous ones."""
    spark = docs.sparkSession
    prepare_workers(spark)
    sent, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names, _, ambiguous = sent.value.predict(texts_as_bytes(batch.column(at)))
            yield batch.filter(pa.array([n != UND and not (reject_ambiguous and a) for n, a in zip(names, ambiguous.tolist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
