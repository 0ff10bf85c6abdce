"""Language ID: each document as a mixture of languages, found by expectation-maximisation over its n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_arrow, table

#: N-grams are hashed to so many buckets; a model has this many numbers for each language.
BUCKETS = 1 << 14
UNDETERMINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """The bucket of each trigram of the lower-cased text that has a letter in its middle; what isn't a letter is a space."""
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cp]
    x = np.where(letter, cp, np.uint32(32))
    h = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)
    return (((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKETS.bit_length() + 1))[letter[1:-1]]


@dataclass
class Model:
    langs: list[str]
    p: np.ndarray  # bucket x language: probability of the bucket

    def mixture(self, counts: list[tuple[np.ndarray, np.ndarray]], rounds: int = 10, weight: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (document x language) of the chosen set of languages, and the log-likelihood, for n-gram counts.

        First all languages take part. Then sets of the 1, 2, ... likeliest are fitted anew; one more language must
        raise the log-likelihood by over max(log(n) / 2, weight * n) for n n-grams, as in a Bayesian criterion with a
        share for n-grams that depend on each other; a document takes the last set that did.
        """
        n_docs, n_langs = len(counts), len(self.langs)
        size = np.array([len(b) for b, _ in counts])
        start = np.r_[0, np.cumsum(size)[:-1]]
        p = self.p[np.concatenate([b for b, _ in counts])]
        c = np.concatenate([c for _, c in counts]).astype(np.float64)
        total = np.add.reduceat(c, start)

        def fit(docs, share, times):
            at = np.concatenate([np.arange(start[d], start[d] + size[d]) for d in docs])
            first = np.r_[0, np.cumsum(size[docs])[:-1]]
            own, q, w = np.repeat(np.arange(len(docs)), size[docs]), p[at], c[at]
            for _ in range(times):
                r = share[own] * q
                s = r.sum(1)
                share = np.add.reduceat(r * (w / s)[:, None], first) / total[docs][:, None]
            return share, np.add.reduceat(w * np.log((share[own] * q).sum(1)), first)

        every = np.arange(n_docs)
        order = np.argsort(-fit(every, np.full((n_docs, n_langs), 1 / n_langs), rounds)[0], axis=1, kind="stable")
        best = np.zeros((n_docs, n_langs))
        best[every, order[:, 0]] = 1
        best, like = fit(every, best, 0)
        left = every
        for more in range(2, n_langs + 1):
            share = np.zeros((len(left), n_langs))
            np.put_along_axis(share, order[left, :more], 1 / more, 1)
            share, now = fit(left, share, rounds)
            won = now - like[left] > np.maximum(np.log(total[left]) / 2, weight * total[left])
            left = left[won]
            if not len(left):
                break
            best[left], like[left] = share[won], now[won]
        return best, like

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[tuple[str, float]]]]:
        lang, score, sets = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        own, counts = [], []
        for i, t in enumerate(texts):
            g = grams(t or "")
            if len(g) and self.langs:
                n = np.bincount(g, minlength=BUCKETS)
                b = np.flatnonzero(n)
                own.append(i)
                counts.append((b, n[b]))
        if own:
            share, _ = self.mixture(counts)
            for i, s in zip(own, share, strict=True):
                top = int(s.argmax())
                lang[i], score[i] = self.langs[top], float(min(1.0, s[top]))
                sets[i] = [(self.langs[k], float(s[k])) for k in np.argsort(-s, kind="stable") if s[k] > 0]
        return lang, score, sets


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5, most: int = 1_000) -> Model:
    """Bucket probabilities by language, from every row of `df` with a text and a language.

    Each task sends at most BUCKETS counts for each language and batch, and only the sums come to the driver:
    BUCKETS numbers for each language, however many rows there are. A column with over `most` values is no column of
    languages, and raises.
    """

    def batch(cols):
        by: dict[str, list[np.ndarray]] = {}
        for t, lang in zip(cols["text"], cols["lang"], strict=True):
            by.setdefault(lang, []).append(grams(t))
        out = {"lang": [], "bucket": [], "n": []}
        for lang, parts in by.items():
            n = np.bincount(np.concatenate(parts), minlength=BUCKETS)
            b = np.flatnonzero(n)
            out["lang"] += [lang] * len(b)
            out["bucket"] += b.tolist()
            out["n"] += n[b].tolist()
        yield out

    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = map_arrow(rows, batch, "lang string, bucket int, n bigint", text="text", chars=8_000_000).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if df.select(lang_col).where(F.col(lang_col).isNotNull()).distinct().limit(most + 1).count() > most:
        raise ValueError(f"{lang_col} has over {most} values")
    found = counts.toArrow()
    lang, bucket, n = (found.column(k).to_pylist() for k in ("lang", "bucket", "n"))
    langs = sorted(set(lang))
    place = {x: i for i, x in enumerate(langs)}
    c = np.full((BUCKETS, len(langs)), smoothing)
    c[bucket, [place[x] for x in lang]] += n
    return Model(langs, c / c.sum(0))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, languages) for each row, after the columns named in `carry`: the language of the largest proportion, that proportion, and the
    chosen set as array<struct<lang, share>>.

    `und`, 0 and no set where the text is null or has no letter, or where the model knows no language. Ties go to the
    first language in order of name. Texts are read whole; repeated rows are answered again; other columns are ignored.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def batch(cols):
        lang, score, sets = sent.value.predict(cols["text"])
        yield {"id": cols["id"], "lang_pred": lang, "score": score, "languages": [[{"lang": k, "share": v} for k, v in s] for s in sets]}

    kind = df.schema[id_col].dataType.simpleString()
    held = tuple(f"carried_{i}" for i in range(len(carry)))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(h) for c, h in zip(carry, held, strict=True)])
    out = map_arrow(rows, batch, f"id {kind}, lang_pred string, score double, languages array<struct<lang: string, share: double>>", text="text", chars=1_000_000, carry=held)
    return out.select(*[F.col(h).alias(c) for c, h in zip(carry, held, strict=True)], *([F.col("id").alias(id_col)] if id_col not in carry else []), "lang_pred", "score", "languages")


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def langid_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.transform("languages", lambda x: F.concat_ws(":", x.lang, F.round(x.share, 4).cast("string"))).alias("languages"))
