"""The pipeline, stage by stage, against brute force over a small table."""

import hashlib
import math
import re

import numpy as np
import public_tokenizers

import corpus_pipeline
from pixelloom.llm import byte_bpe


def sentence(n, seed):
    return " ".join("w" + str(v) for v in np.random.default_rng(seed).integers(0, 5000, n))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def grams(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_stages(spark, tmp_path):
    base, passage = sentence(200, 1), sentence(60, 2)
    near = base.replace(base.split()[100], "other", 1)
    rows = [(1, base), (2, near), (3, base), (4, None), (5, "too short"), (6, "spam spam spam " * 40), (7, "### $$$ %%% " + sentence(20, 7).replace("w", "#*")), (8, sentence(90, 3) + "\n" + passage), (9, passage + "\n" + sentence(70, 4))]
    rows += [(i, sentence(40 + i, 100 + i)) for i in range(10, 30)]
    table = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == table.columns
        seen[name] = docs.collect()
    texts = dict(rows)
    first = [r.doc_id for r in seen["quality rules"]]
    assert set(first) == set(texts) - {4, 5, 6, 7}
    second = {r.doc_id: r.text for r in seen["n-gram Jaccard join"]}
    sets = {i: grams(texts[i], 5) for i in first}
    assert set(second) == {i for i in first if not any(j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in first)}
    third = {r.doc_id: r for r in seen["substring dedup"]}
    assert set(third) == set(second) and words(third[9].text) == words(sentence(70, 4)) and all(third[i].text == second[i] for i in second if i != 9)
    windows = [g for r in third.values() for g in grams(r.text, 50)]
    assert len(windows) == len(set(windows)) and all(r.n_chars == len(r.text) for r in third.values())
    size = {s: sum(len(r.text) for r in third.values() if r.source == s) for s in ("s0", "s1", "s2")}
    weight = {s: math.floor(math.sqrt(n) * 1000) for s, n in size.items()}
    copies = {}
    for r in seen["mixing sources"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.text == third[r.doc_id].text
    for i, r in third.items():
        rate = sum(size.values()) * weight[r.source] / sum(weight.values()) / size[r.source]
        u = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        assert copies.get(i, 0) == n
    encoding = byte_bpe.load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    last = seen["byte-level BPE"]
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in seen["mixing sources"])
    for r in last:
        ids = encoding.encode_ordinary(third[r.doc_id].text)
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(third[r.doc_id].text.encode()).hexdigest()
