import hashlib
import random
import re

import numpy as np
from helpers import DOC, EDGE, docs

from guide_engine.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for n, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), n, kind, m.end()))
    return [(a, k, b) for a, _, k, b in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    pieces = ["1", "22", "255", "256", ".", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "é", "4111111111111111", "@x.y", "00000"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == brute(text), text
    for text in ("a@b@c.d", "x@y.z@w.v", "1.2.3.4.5.6.7.8.9", "0000001.2.3.4", "+1 (555) 123-4567"):
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for unit in ("a", "1", "1.", "+1", "@", "a@", "1 ", "-", "a.@b"):
        pii.base_spans(unit * 200_000)


def test_gradient():
    rng = np.random.default_rng(0)
    model = pii.Tagger()
    model.p["tr"] = rng.normal(0, 0.3, model.p["tr"].shape)
    codes = rng.integers(0, 100, (3, 12))
    tags = np.stack([pii.tags_of([(2, "ip", 6)], 12), pii.tags_of([], 12), pii.tags_of([(0, "card", 12)], 12)])
    _, g = model.loss_gradient(codes, tags)
    for name in model.p:
        at = tuple(rng.integers(0, s) for s in model.p[name].shape)
        if name == "emb":
            at = (codes[0, 3], 2)
        if name == "tr":
            at = (5, 6)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-5
        up = model.loss_gradient(codes, tags)[0]
        model.p[name][at] = old - 1e-5
        down = model.loss_gradient(codes, tags)[0]
        model.p[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4, name


def test_decode_and_posterior_equal_enumeration():
    from itertools import product

    model = pii.Tagger()
    rng = np.random.default_rng(1)
    model.p["tr"] = rng.normal(0, 0.5, model.p["tr"].shape)
    e = rng.normal(0, 1, (4, pii.TAGS))
    tr = model.p["tr"] + model.ok
    score = {p: e[0, p[0]] + model._start()[p[0]] + sum(tr[p[s - 1], p[s]] + e[s, p[s]] for s in range(1, 4)) for p in product(range(pii.TAGS), repeat=4)}
    assert tuple(model.decode(e[None])[0]) == max(score, key=score.get)
    z = np.logaddexp.reduce(list(score.values()))
    want = np.exp(np.logaddexp.reduce([v for p, v in score.items() if p[1] == 3 and p[2] == 4 and p[3] != 4]) - z)
    assert abs(model.posterior(e[None], [(1, 3, 1)])[0] - want) < 1e-9


def added(model, examples):
    """What the network adds to the patterns on labelled examples: (found, wanted, right)."""
    texts = [t for t, _ in examples]
    base = [pii.base_spans(t) for t in texts]
    found = pii.added_spans(model, texts, base)
    free = lambda s, own: not any(a < s[2] and s[0] < b for a, _, b in own)
    want = [{s for s in spans if free(s, own) and pii.plausible(s[1], t[s[0] : s[2]])} for (t, spans), own in zip(examples, base)]
    return sum(map(len, found)), sum(map(len, want)), sum(len(set(f) & w) for f, w in zip(found, want))


def test_network_finds_held_out_spans_that_no_pattern_holds():
    model = pii.train([]).cast(np.float32)
    found, want, right = added(model, pii.examples(400, seed=99))
    assert want > 100 and right >= 0.75 * want and right >= 0.9 * found
    long = "word " * 300
    text = long + "token = " + "a1b2" * 10 + " and (555) 201-3344 " + long
    (spans,) = pii.added_spans(model, [text], [[]])
    assert ("secret", "a1b2" * 10) in [(k, text[a:b]) for a, k, b in spans]


def test_tags_that_run_on_are_decoded_to_their_end(monkeypatch):
    """A span far longer than a window, with one digit at its end: the windows before it are decoded too."""
    model = pii.Tagger()
    text = "x" * 100 + "S" * 700 + "7" + "x" * 100
    monkeypatch.setattr(model, "emissions", lambda codes: np.stack([codes, codes], 2))

    def decode(e):
        codes = e[:, :, 0]
        inside = (codes == pii._code("S")[0]) | (codes == pii._code("7")[0])
        tags = np.where(inside, 10, 0)
        begins = inside & (np.concatenate([np.zeros((len(e), 1)), codes[:, :-1]], 1) == pii._code("x")[0])
        return np.where(begins, 9, tags)

    monkeypatch.setattr(model, "decode", decode)
    monkeypatch.setattr(model, "posterior", lambda e, spans: np.ones(len(spans)))
    assert pii.added_spans(model, [text], [[]]) == [[(100, "secret", 801)]]


def test_digest_and_masks(spark):
    texts = EDGE + ["mail a.b@c.org or +1 (555) 123-4567 from 10.0.0.255 with 4111 1111 1111 1111é", None]
    table = docs(spark, texts)
    table = table.union(table)
    model = pii.Tagger()
    rows = pii.find(spark, table, model).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        base = brute(texts[r["doc_id"]] or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in base) for k in pii.KINDS]
        assert set(joined.split(",")) <= set(r["spans"].split(","))
    out = pii.redact(spark, table, model)
    assert out.columns == table.columns
    assert "mail <EMAIL> or <PHONE> from <IP> with <CARD>é" in {r["text"] for r in out.collect()}
    assert pii.masked("abcdef", [(0, "ip", 3), (2, "card", 5)]) == "<IP>f"
    assert pii.find(spark, spark.createDataFrame([], DOC), model).count() == 0
    assert isinstance(pii.fit(spark, spark.createDataFrame([], DOC)), pii.Tagger)
