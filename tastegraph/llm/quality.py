"""Quality classifier by positive-unlabelled learning.

A small network over text statistics minimises the non-negative unbiased risk
``pi R_p(+) + max(0, R_u(-) - pi R_p(-))`` (Kiryo et al., NeurIPS 2017) with trusted
positives and unlabelled web text; no negative label is ever read. The class prior
``pi`` comes from the same two samples: the least ratio of unlabelled to positive mass
above any score (best-bin estimate, Garg et al., NeurIPS 2021), on rows that the ranking
network was not fitted to.

Nulls, blanks: a null text counts as empty; empty and blank texts get a score like any
other. Repeated rows are scored each. Without positives every score is 0.5. An empty
table gives an empty result. Extra columns of the inputs are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.labelled import crc_mod, labelled_texts, map_rows, spread, texts_of

#: Bounds of the two training samples.
POSITIVES = 8000
UNLABELLED = 16000
HIDDEN, EPOCHS, BATCH, RATE = 24, 60, 512, 0.01


def _classes() -> np.ndarray:
    """256 x groups: which byte counts feed which character share."""
    groups = [range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b"\t\r\x0b\x0c", b".,;:?'\"", b"!", b"#$%&*@^~", b"|/\\_=+<>", b"()[]{}", range(128, 256), range(0, 9)]
    table = np.zeros((256, len(groups)))
    for k, g in enumerate(groups):
        table[list(g), k] = 1
    return table


_TABLE = _classes()


def features(text: str) -> list[float]:
    """Statistics of the whole text."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words = text.split()
    k = len(words)
    kinds = set(words)
    lines = [x for x in text.split("\n") if x]
    share = counts / n
    entropy = -float(np.sum(share[share > 0] * np.log(share[share > 0])))
    size = np.log1p(k)
    # Words that stand again one to four places on: loops of words and of phrases.
    back = max((sum(map(eq, words[d:], words)) / (k - d) for d in (1, 2, 3, 4) if k > d), default=0.0)
    return [
        *(counts @ _TABLE / n).tolist(), entropy, size, n / (k + 1) / 10, len(kinds) / max(1, k), np.log1p(len(kinds)) / max(1.0, size),
        len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), np.log1p(len(text)) - np.log1p(len(lines)), back,
        sum(w[-1].isalnum() for w in words) / max(1, k), sum(w.isupper() for w in words) / max(1, k), len({*zip(words, words[1:])}) / max(1, k - 1),
    ]


WIDTH = len(features(""))


def _forward(net: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ net["w1"] + net["b1"])
    return h, h @ net["w2"] + net["b2"]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(pos: np.ndarray, unl: np.ndarray, pi: float, seed: int, epochs: int) -> dict[str, np.ndarray]:
    """Adam on the non-negative risk with the logistic loss; where the negative part falls below zero its gradient is reversed."""
    rng = np.random.default_rng(seed)
    net = {"w1": rng.normal(0, pos.shape[1] ** -0.5, (pos.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b2": np.zeros(())}
    m, v, t = ({k: np.zeros_like(x) for k, x in net.items()} for _ in range(2)), None, 0
    m, v = m
    for _ in range(epochs):
        order = rng.permutation(len(unl))
        for at in range(0, len(order), BATCH):
            u, p = unl[order[at : at + BATCH]], pos[rng.integers(0, len(pos), BATCH)]
            x = np.concatenate([p, u])
            h, z = _forward(net, x)
            zp, zu = z[: len(p)], z[len(p) :]
            negative = np.logaddexp(0, zu).mean() - pi * np.logaddexp(0, zp).mean()
            gp, gu = -pi * _sigmoid(-zp) / len(p), np.zeros(len(u))
            if negative >= 0:
                gp, gu = gp - pi * _sigmoid(zp) / len(p), _sigmoid(zu) / len(u)
            else:
                gp, gu = pi * _sigmoid(zp) / len(p), -_sigmoid(zu) / len(u)
            g = np.concatenate([gp, gu])
            back = np.outer(g, net["w2"]) * (1 - h * h)
            grad = {"w1": x.T @ back + 1e-4 * net["w1"], "b1": back.sum(0), "w2": h.T @ g + 1e-4 * net["w2"], "b2": g.sum()}
            t += 1
            for k in net:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                net[k] = net[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives in the unlabelled sample: least ratio of masses above a score, with its sampling error."""
    ps, us = np.sort(pos), np.sort(unl)
    cut = np.quantile(ps, np.linspace(0, 0.95, 96))
    above_p = 1 - np.searchsorted(ps, cut, "left") / len(ps)
    above_u = 1 - np.searchsorted(us, cut, "left") / len(us)
    error = 1 / np.sqrt(len(ps)) + 1 / np.sqrt(len(us))
    best = np.argmin((above_u + error) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def train(pos: np.ndarray, unl: np.ndarray) -> dict:
    """Model as plain lists: prior, scaling and network."""
    if not len(pos) or not len(unl):
        return {}
    both = np.concatenate([pos, unl])
    mean, std = both.mean(0), both.std(0) + 1e-6
    p, u = np.clip((pos - mean) / std, -8, 8), np.clip((unl - mean) / std, -8, 8)
    prior = 0.5
    if len(p) > 20 and len(u) > 20:
        ranker = _fit(p[::2], u[::2], 0.5, 1, max(8, EPOCHS // 3))
        prior = estimate_prior(_forward(ranker, p[1::2])[1], _forward(ranker, u[1::2])[1])
    net = _fit(p, u, prior, 2, EPOCHS)
    return {"prior": prior, "mean": mean.tolist(), "std": std.tolist(), "net": {k: x.tolist() for k, x in net.items()}}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of good quality."""
    if not model:
        return np.full(len(x), 0.5)
    net = {k: np.array(v) for k, v in model["net"].items()}
    return _sigmoid(_forward(net, np.clip((x - np.array(model["mean"])) / np.array(model["std"]), -8, 8))[1])


def fit_quality(docs: DataFrame, labels: DataFrame, allowed=None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict:
    """Train on at most ``positives`` trusted and ``unlabelled`` unlabelled documents, in one task."""
    allowed = F.lit(True) if allowed is None else allowed
    trusted = labelled_texts(docs, labels, "quality", allowed, positives, only=1).select(F.lit(1).alias("p"), "doc_id", "text")
    chosen = spread(docs.where("doc_id is not null").select("doc_id").distinct(), unlabelled)
    web = texts_of(docs, chosen).select(F.lit(0).alias("p"), "doc_id", "text")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"p": pdf["p"], "doc_id": pdf["doc_id"], "x": [features(t) for t in pdf["text"]]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        pdf = pd.concat(rows)
        pdf["x"] = pdf["x"].map(tuple)
        pdf = pdf.sort_values(["p", "doc_id", "x"])
        x, p = np.array(pdf["x"].tolist()).reshape(-1, WIDTH), pdf["p"].to_numpy() == 1
        rng = np.random.default_rng(0)
        yield pd.DataFrame({"model": [json.dumps(train(rng.permutation(x[p]), rng.permutation(x[~p])))]})

    measured = trusted.unionByName(web).mapInPandas(measure, f"p int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")
    row = measured.repartition(1).mapInPandas(learn, "model string").first()
    return json.loads(row["model"]) if row else {}


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, score)`` for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([features(t) for t in pdf["text"]]).reshape(-1, WIDTH)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": predict(model, x)})

    return map_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``; rows with crc32(doc_id) mod 3 = 1 are held out."""
    model = fit_quality(docs, labels, crc_mod("doc_id", 3) != 1)
    return score_quality(docs, model).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored below 0.5; same columns."""
    names = docs.columns
    model = fit_quality(docs, labels, crc_mod("doc_id", 3) != 1)
    source = docs.select(F.struct(*names).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(predict(model, np.array([features(t) for t in texts]).reshape(-1, WIDTH)))

    return source.where(score("text") >= 0.5).select("row.*")
