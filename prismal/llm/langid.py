"""Language identification by rank-order n-gram profiles.

A profile is a list of n-grams (one to three letters, with word ends) in order
of frequency.  A document goes to the language whose profile has its most
frequent n-grams least out of place.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismal.llm.common import map_rows, ship

#: Documents that a language's profile is fitted on at most, taken by a hash of their ids.
FIT_ROWS_PER_LANGUAGE = 2000
PROFILE = 1000
DOC_PROFILE = 400
UND = "und"
_EDGE = 1


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, packed into 63 bits, and their counts.

    Everything but letters is a word end; n-grams do not run across one.
    """
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[raw] if len(raw) else np.zeros(0, bool)
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    body = np.where(is_letter, raw, _EDGE)[keep].astype(np.int64)
    c = np.concatenate([[_EDGE], body, [_EDGE]]) if body[-1] != _EDGE else np.concatenate([[_EDGE], body])
    one = c[c != _EDGE]
    two = c[:-1] << 21 | c[1:]
    mid = c[1:-1] != _EDGE
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[mid]
    grams = np.sort(np.concatenate([one, two, three]))
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(np.append(first, len(grams)))


def ranked(grams: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent n-grams, ties by code."""
    if len(grams) > 2 * k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        some = counts >= least
        grams, counts = grams[some], counts[some]
    return grams[np.lexsort((grams, -counts))[:k]]


def fit_profiles(docs: DataFrame, per_language: int = FIT_ROWS_PER_LANGUAGE, size: int = PROFILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Profiles (n-gram codes by rank) of every language of ``docs``.

    About ``per_language`` documents of each are read whole, chosen by a hash
    of their ids; null ids, languages and texts are left out.  The driver holds
    one profile per language.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    share = known.groupBy("lang").count().select("lang", (F.lit(float(per_language)) / F.col("count")).alias("share"))
    rows = share.collect()  # one row a language
    limits = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, float(r.share)) for r in rows], "lang string, share double"))
    sample = known.join(limits, "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def count(cols: list[list]) -> dict[str, list]:
        texts: dict[str, list[str]] = {}
        for text, lang in zip(*cols):
            texts.setdefault(lang, []).append(text)
        out: dict[str, list] = {"lang": [], "gram": [], "n": []}
        for lang, each in texts.items():
            g, n = ngrams("\n".join(each))
            out["lang"] += [lang] * len(g)
            out["gram"] += g.tolist()
            out["n"] += n.tolist()
        return out

    total = map_rows(sample.select("text", "lang"), count, "lang string, gram long, n long", 4 << 20).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).orderBy("lang", "rank").collect()
    profiles: dict[str, list[int]] = {}
    for r in top:
        profiles.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, np.int64) for k, v in sorted(profiles.items())}


class Judge:
    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = list(profiles)
        self.tables = []
        for p in profiles.values():
            order = np.argsort(p)
            self.tables.append((p[order], order))

    def __call__(self, text: str | None) -> tuple[str, float]:
        doc = ranked(*ngrams(text), DOC_PROFILE)
        if not len(doc) or not self.names:
            return UND, 0.0
        rank, found = np.arange(len(doc)), []
        for codes, places in self.tables:
            at = np.minimum(np.searchsorted(codes, doc), len(codes) - 1)
            there = codes[at] == doc
            found.append(int(np.where(there, np.abs(places[at] - rank), PROFILE).sum()))
        best = int(np.argmin(found))
        rest = min((d for i, d in enumerate(found) if i != best), default=PROFILE * len(doc))
        return self.names[best], rest / (found[best] + rest) if found[best] + rest else 0.5


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: ``doc_id, lang_pred, score``.

    ``und`` with score 0 for a null text, one without letters, or where no
    profile exists.  The score is the runner-up's distance as a share of the
    two smallest: 0.5 for a tie, towards 1 for a clear case.  Equal distances
    go to the first name.  Rows keep null and repeated ids.
    """
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(cols: list[list]) -> dict[str, list]:
        judge = Judge(known.value)
        said = [judge(t) for t in cols[1]]
        return {"doc_id": cols[0], "lang_pred": [x[0] for x in said], "score": [x[1] for x in said]}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, lang_pred string, score double")
