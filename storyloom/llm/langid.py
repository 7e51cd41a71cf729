"""Language proportions of documents by expectation-maximisation over character n-gram models.

A model holds, per language, the probability of each of BUCKETS hashed byte n-grams. A document is a mixture: each of
its n-grams comes from one of a set of languages. Expectation-maximisation finds the proportions; languages enter the
set one by one as long as the penalised likelihood grows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm import tokens

GRAM = 3
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.5
ROUNDS = 30

#: Languages that are tried at a time, and the margin of bounds for the rounding of sums.
STEP = 32
SLACK = 1e-9

#: Likelihoods of one document that are held while it is worked on; of more, those of STEP languages are made again when
#: they are asked for, with the same results.
HELD = 1 << 20

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"

#: Most languages of one model by default. A language takes 128 KB of the table that is sent to every executor.
MAX_LANGUAGES = 1000


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams within rows of lower-cased text whose gaps and ASCII non-letters are single values,
    and where each row's trigrams begin; one entry more than rows."""
    plain = FOLD[data].astype(np.uint64)
    n = len(plain) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    code = plain[:n] | (plain[1 : n + 1] << np.uint64(8)) | (plain[2 : n + 2] << np.uint64(16))
    keep = ~((plain[:n] == 32) & (plain[1 : n + 1] == 32)) & ~((plain[1 : n + 1] == 32) & (plain[2 : n + 2] == 32))
    for back in range(1, GRAM):
        cut = offs[1:-1] - back
        keep[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(keep)
    return ((code[at] * np.uint64(tokens.BASES[0])) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.searchsorted(at, offs)


FOLD = tokens.LOWER.copy()
FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def padded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows between blanks, so that every letter, also the first or only one, is in the middle of a trigram."""
    wide = offs + 2 * np.arange(len(offs))
    out = np.full(wide[-1], 32, np.uint8)
    for k in range(len(offs) - 1):
        out[wide[k] + 1 : wide[k + 1] - 1] = data[offs[k] : offs[k + 1]]
    return out, wide


def split_rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, trigram buckets) of each row of a column, a bounded piece of text at a time."""
    data, offs = tokens.text_buffer(column)
    row = 0
    while row < len(offs) - 1:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + tokens.PIECE, "right")) - 1)
        got, first = grams(*padded(data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]))
        for k in range(end - row):
            yield row + k, got[first[k] : first[k + 1]]
        row = end


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts per language of one task's rows."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for row, got in split_rows(batch.column(1)):
            if langs[row] not in total:
                total[langs[row]] = np.zeros(BUCKETS, np.int64)
            total[langs[row]] += np.bincount(got, minlength=BUCKETS)
    for lang, counts in total.items():
        spots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(spots), pa.string()), pa.array(spots), pa.array(counts[spots])], ["lang", "bucket", "n"])


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text or ""))


def log_row(table: pa.Table) -> pa.Table:
    """One language's log probabilities of all buckets, as the bytes of float32 values, from its counts."""
    counts = np.full(BUCKETS, SMOOTHING)
    counts[table.column("bucket").to_numpy()] += table.column("n").to_numpy()
    return pa.table({"lang": table.column("lang")[:1], "logp": pa.array([np.log(counts / counts.sum()).astype(np.float32).tobytes()], pa.binary())})


def learn(labelled: DataFrame, lang_col: str, text_col: str, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """(languages in order, log probabilities [language, bucket]) from all rows of ``labelled`` with both values.

    Counts are added up per task before the shuffle, and one task a language makes its row of the table from at most
    BUCKETS sums; the driver gets these rows, 128 KB each, as bytes. More labels than ``max_languages`` are an error, as
    leaving out some would give their texts a wrong language.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"))
    langs = sorted(r.lang for r in rows.select("lang").distinct().limit(max_languages + 1).collect())
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages are labelled; raise max_languages, at 128 KB of memory each")
    logp = np.full((len(langs), BUCKETS), -np.log(BUCKETS), np.float32)
    counts = rows.mapInArrow(counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    place = {x: k for k, x in enumerate(langs)}
    for r in counts.groupBy("lang").applyInArrow(log_row, "lang string, logp binary").collect() if langs else []:
        logp[place[r.lang]] = np.frombuffer(r.logp, np.float32)
    return langs, logp


def proportions(likely: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """EM over the columns of ``likely`` (n-gram, language), n-grams weighted: proportions and mean log likelihood."""
    share = np.full(likely.shape[1], 1 / likely.shape[1])
    if likely.shape[1] > 1:
        for _ in range(ROUNDS):
            part = likely * share
            new = weights @ (part / part.sum(axis=1, keepdims=True))
            if np.abs(new - share).max() < 1e-4:
                share = new
                break
            share = new
    return share, float(weights @ np.log(likely @ share))


def best_addition(likely, weights: np.ndarray, now: np.ndarray, ratio: np.ndarray, rest: np.ndarray) -> int:
    """The language of ``rest`` that adds most to the mean log likelihood when a tenth of the document is given to it.

    As log(1 + x) <= x, a language adds at most a ninth of its ``ratio``, the mean of its likelihood over that of the
    mixture ``now``. Languages are tried by descending ratio, STEP at a time, until none that is left can add as much.
    """
    order = rest[np.argsort(-ratio[rest], kind="stable")]
    most, found = -np.inf, []
    base = float(weights @ np.log(0.9 * now))
    for k in range(0, len(order), STEP):
        tried = order[k : k + STEP]
        if base + ratio[tried[0]] / 9 < most - SLACK:
            break
        gains = weights @ np.log(0.9 * now[:, None] + 0.1 * likely(tried))
        found += zip((-gains).tolist(), tried.tolist(), strict=True)
        most = max(most, float(gains.max()))
    return min(found)[1]


def mixture(buckets: np.ndarray, logp: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(set of languages, proportions) of one document by penalised likelihood, grown greedily from the best language.

    The mean log likelihood is concave in the proportions, so no proportions over the chosen languages and one more can
    raise it by more than the largest of their ratios less one (see ``best_addition``). Where that is within the penalty
    the search ends without trying any. Memory grows with the distinct n-grams times STEP, not times the languages.
    """
    spots, n = np.unique(buckets, return_counts=True)
    total = n.sum()
    weights = n / total
    sub = logp[:, spots]
    top = sub.max(axis=0).astype(np.float64)
    blocks = [np.arange(k, min(k + STEP, len(sub))) for k in range(0, len(sub), STEP)]
    made = lambda ks: np.exp(sub[ks].astype(np.float64) - top).T
    table = made(np.arange(len(sub))) if sub.size <= HELD else None
    likely = made if table is None else lambda ks: table[:, ks]
    single = np.concatenate([sub[ks].astype(np.float64) @ weights for ks in blocks])
    chosen = [int(single.argmax())]
    share, best = proportions(likely(chosen), weights)
    penalty = 0.5 * np.log(total) / total
    while len(chosen) < len(sub):
        now = likely(chosen) @ share
        ratio = np.concatenate([(weights / now) @ likely(ks) for ks in blocks])
        if ratio.max() - 1 <= penalty - SLACK:
            break
        k = best_addition(likely, weights, now, ratio, np.setdiff1d(np.arange(len(sub)), chosen))
        new_share, value = proportions(likely([*chosen, k]), weights)
        if value - best <= penalty:
            break
        chosen, share, best = [*chosen, k], new_share, value
    return chosen, share


def predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp = shared.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            texts, pred, score, mixed = batch.column(1), [], [], []
            for row, got in split_rows(texts):
                if not langs or not has_letter(texts[row].as_py()):
                    pred.append(UNKNOWN), score.append(0.0), mixed.append([])
                    continue
                chosen, share = mixture(got, logp)
                order = sorted(zip(share.tolist(), [langs[k] for k in chosen], strict=True), key=lambda x: (-x[0], x[1]))
                pred.append(order[0][1]), score.append(min(1.0, max(0.0, order[0][0])))
                mixed.append([{"lang": lang, "share": s} for s, lang in order])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, kind)], ["id", "lang_pred", "score", "languages"])

    return run


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """One row per row of ``docs``: the id, lang_pred, score (its proportion) and all languages with proportions.

    Learns from ``labelled``, whose labels are ``max_languages`` at most. A text that is null or has no letter is ``und``
    with score 0, as is every text if nothing was learned; any other text gets a learned language, however short it is.
    Null ids stay null, repeated rows give equal results, other columns are not read; empty tables give empty ones. Very
    long texts count whole; their n-grams are made a piece at a time and held together, eight bytes each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(labelled, lang_col, text_col, max_languages))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = dict(slim.dtypes)["id"]
    out = slim.mapInArrow(predictor(shared), f"id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    return out.withColumnRenamed("id", id_col)
