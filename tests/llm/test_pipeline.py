"""The pipeline, stage by stage, against plain Python."""
import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink.llm import bpe, langid, mixing, secret_scan

pipeline = pytest.importorskip("corpus_pipeline")

SECRET = "password=hunter2hunter2"


def shingles(text):
    w = text.split()
    return collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else collections.Counter([tuple(w)])


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Texts of two languages, copies, near copies, secrets, texts of no language, and columns that clash."""
    import random
    rng = random.Random(2)
    vocabulary = {"en": "the quick of that with and river stone house every morning light under".split(), "de": "der und ich nicht über die Straße haus jeden morgen licht unter mit".split()}

    def text(lang, n):
        return " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(n))

    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        rows.append((i, text(lang, rng.randint(20, 120)) + (f" {SECRET} end" if i % 10 == 0 else ""), lang, f"s{i % 3}"))
    base = text("en", 200).split()
    rows += [(200, " ".join(base), "en", "s0"), (201, " ".join(base), "en", "s1"), (202, " ".join(base[:198] + ["other", "words"]), "en", "s2"), (300, None, "en", "s0"), (301, "123 456 !!", "de", "s1"), (302, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"score": F.lit(7.5), "lang_pred": F.lit("mine"), "n_chars": F.length("text").cast("long"), "_mix": F.lit("kept"), "_spans": F.lit("kept")})
    folder = tmp_path_factory.mktemp("pipeline")
    df.write.parquet(str(folder / "documents.parquet"))
    return spark.read.parquet(str(folder / "documents.parquet")), str(folder)


def test_stages(spark, docs):
    now, folder = docs
    columns = now.columns
    seen = {}
    for name, stage in pipeline.STAGES:
        now = pipeline.materialise(stage(spark, now, folder), f"test-{name}")
        seen[name] = now
        if name != "tokens":
            assert now.columns == columns and all(tuple(r) == (7.5, "mine", "kept", "kept") for r in now.select("score", "lang_pred", "_mix", "_spans").distinct().collect())
    language = {r["doc_id"]: r["text"] for r in seen["language"].collect()}
    assert not {300, 301, 302} & set(language) and {200, 201, 202} <= set(language) and len(language) > 115
    # one of each class, by all pairs
    ids = sorted(language)
    sets, parent = {d: shingles(language[d]) for d in ids}, {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = sum((sets[a] & sets[b]).values())
            if both / (sum(sets[a].values()) + sum(sets[b].values()) - both) >= 0.8:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    near = {r["doc_id"]: r["text"] for r in seen["near"].collect()}
    assert near == {d: language[d] for d in ids if find(d) == d}
    clean = {r["doc_id"]: r for r in seen["secrets"].collect()}
    spans = {r["doc_id"]: r["_spans"] for r in secret_scan.scan_secrets(seen["near"].drop("_spans")).collect()}
    for d, t in near.items():
        out, at = [], 0
        for s in spans[d]:
            if s["start"] >= at:
                out.append(t[at:s["start"]])
            at = max(at, s["end"])
        assert clean[d]["text"] == "[SECRET]".join([*out, t[at:]]) and clean[d]["n_chars"] == len(clean[d]["text"]) and SECRET not in clean[d]["text"]
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan_mix(seen["secrets"]).select("doc_id", "_mix.copies").collect()}
    assert collections.Counter(r["doc_id"] for r in seen["mix"].collect()) == collections.Counter({d: n for d, n in plan.items() if n})
    tokens = bpe.load()
    want = collections.Counter()
    for r in seen["mix"].collect():
        ids = tokens.encode(r["text"])
        want[r["doc_id"], r["source"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokens.decode(ids).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in seen["tokens"].collect()) == want
    assert collections.Counter(tuple(r) for r in pipeline.run(spark, folder).collect()) == want


def test_empty_table(spark, docs, tmp_path):
    docs[0].limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_kept_names(docs):
    found = langid.predicted(docs[0], langid.fit(docs[0]), ("_lang_pred", "_score"))
    assert found.columns == [*docs[0].columns, "_lang_pred", "_score"]
