"""Operators on small tables: nulls, empty and long texts, ties, repeats, empty tables, other columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import byte_bpe, chat_tree, components, cover_tree, kneser_ney, language_id, mixing, ngram_jaccard, quality_rules, registry, substring_dedup, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, n int"
RNG = np.random.default_rng(11)


def sentence(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("w" + str(v) for v in rng.integers(0, 5000, n))


BASE = sentence(200, 1)
NEAR = BASE.replace(BASE.split()[100], "other", 1)
PASSAGE = sentence(60, 2)
ROWS = [
    (1, BASE, "en", "a"), (2, NEAR, "en", "a"), (3, BASE, None, "b"), (4, None, "en", None), (5, "", "de", "b"), (6, "Two words", "en", "b"), (7, "two WORDS", "de", "a"),
    (8, sentence(90, 3) + " " + PASSAGE + " " + sentence(90, 4), "fr", "a"), (9, sentence(70, 5) + "\n" + PASSAGE + "\n" + sentence(50, 6), "fr", "c"),
    (10, " \n\t ", None, "c"), (11, "der die das und " * 5000, "de", "a"), (12, BASE, "en", "a"), (None, "no id here at all", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 1, 2) for i, t, lang, s in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 7), (None, 1), (20, 21), (21, 22), (22, 20), (20, 21)], "a long, b long")
    assert {r.node: r.component for r in components.connected_components(edges, "a", "b").collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 20: 20, 21: 20, 22: 20}
    assert components.connected_components(edges.limit(0), "a", "b").count() == 0


def test_jaccard(docs, none):
    found = {r.id: r for r in ngram_jaccard.jaccard_groups(docs).collect()}
    sets = {i: {tuple(lowered(t)[k : k + 5]) for k in range(len(lowered(t)) - 4)} or ({tuple(lowered(t))} if lowered(t) else set()) for i, t, *_ in ROWS if i}
    for i, s in sets.items():
        links = [j for j, o in sets.items() if j != i and s and 100 * len(s & o) >= 80 * len(s | o)]
        assert (found[i].n_shingles, found[i].n_links) == (len(s), len(links))
    assert [found[i].component_id for i in (1, 2, 3, 12, 4, 5, 6, 7)] == [1, 1, 1, 1, 4, 5, 6, 6]
    assert None not in found and ngram_jaccard.jaccard_groups(none).count() == 0


def test_jaccard_of_hot_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "PIECE_GRAMS", 2000)
    rng, rows, shared = np.random.default_rng(21), [], sentence(60, 22)
    base = sentence(50, 23).split()
    for i in range(400):
        kind = i % 8
        if kind < 3:  # near copies of one text
            text = " ".join(w if rng.random() > 0.01 else f"x{rng.integers(9)}" for w in base)
        elif kind == 3:  # exact copies
            text = sentence(40, 24)
        elif kind < 6:  # a passage that many share
            text = sentence(int(rng.integers(5, 60)), 2000 + i) + " " + shared
        else:
            text = " ".join(f"v{v}" for v in rng.integers(0, 3, rng.integers(1, 9)))
        rows.append((i % 390, text))
    found = ngram_jaccard.jaccard_groups(passage_table(spark, rows)).select("id", "n_shingles", "n_links", "component_id").collect()
    sets = [{tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)} or {tuple(words(t))} for _, t in rows]
    links = [[j for j, b in enumerate(sets) if j != i and 100 * len(a & b) >= 80 * len(a | b)] for i, a in enumerate(sets)]
    label = list(range(len(rows)))
    for _ in rows:
        new = [min([label[i], *[label[j] for j in links[i]]]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[label[i]] = min(least.get(label[i], doc), doc)
    assert sorted(map(tuple, found)) == sorted((doc, len(sets[i]), len(links[i]), least[label[i]]) for i, (doc, _) in enumerate(rows))
    assert sum(map(len, links)) > 10000


def test_one_of_each_group_is_kept(spark, docs, none):
    other = sentence(80, 50)
    rows = [(5, BASE), (5, other), (5, other), (6, NEAR), (7, other), (8, None), (8, None), (9, " "), (None, BASE), (None, BASE)]
    kept = ngram_jaccard.keep_first(passage_table(spark, [(i, t) for i, t in rows if t is not None]).unionByName(docs.where("doc_id = 4")))
    found = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert found == sorted([(5, BASE), (5, other), (9, " "), (4, ""), (0, BASE), (0, BASE)]) and kept.columns == docs.columns
    assert ngram_jaccard.keep_first(none).count() == 0


def test_jaccard_across_sizes(spark):
    rows = []
    for case, size in enumerate([36, 40, 41, 50, 100, 125, 240, 300] * 4):
        text = sentence(size + 6, 1000 + case)
        rows += [(2 * case, " ".join(text.split()[: size + 4])), (2 * case + 1, text)]
    found = {r.id: r.n_links for r in ngram_jaccard.jaccard_groups(passage_table(spark, rows)).collect()}
    sets = [{tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)} for _, t in rows]
    assert found == {i: sum(j != i and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)} and sum(found.values()) >= 40


def test_passages(spark, docs, none):
    found = substring_dedup.repeated_passages(docs)
    rows = {(r.doc_id, r.source_id): r for r in found.collect()}
    near = rows[9, 8]
    assert (near.start_word, near.end_word, near.source_start, near.n_same) == (70, 130, 90, 60)
    assert rows[2, 1].n_same == 199 and rows[3, 1].n_same == 200 and not any(r.doc_id in (1, 8, 11) for r in rows.values())
    left = {r.doc_id: r for r in substring_dedup.drop_passages(docs, found).collect()}
    assert 3 not in left and 12 not in left and left[4].text is None and left[5].text == "" and left[1].text == BASE and left[None].text
    assert left[9].text == sentence(70, 5) + "\n" + sentence(50, 6) and left[9].key == 1
    assert substring_dedup.repeated_passages(none).count() == 0
    assert substring_dedup.drop_passages(none, substring_dedup.repeated_passages(none)).count() == 0


def passage_table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t), "x", 1, 2) for i, t in rows], DOCS)


def test_smaller_documents_hide_no_source(spark):
    one, two = sentence(30, 30), sentence(30, 31)
    rows = [(3, sentence(40, 32) + " " + one + " " + sentence(40, 33)), (7, two + " " + sentence(60, 34))]
    rows += [(i, sentence(50, i) + " " + one + " " + two + " " + sentence(50, i + 1)) for i in (100, 200)]
    found = substring_dedup.repeated_passages(passage_table(spark, rows))
    assert [tuple(r)[:7] for r in found.collect()] == [(200, 50, 110, 100, 50, 110, 60)]


def test_passages_against_brute_force(spark):
    rng, rows = np.random.default_rng(31), []
    hidden = sentence(200, 32).split()
    for i in range(17):  # short quotes that overlap take every seed of a passage
        rows.append((i, sentence(30, 100 + i) + " " + " ".join(hidden[10 * i : 10 * i + 35]) + " " + sentence(30, 200 + i)))
    rows += [(i, sentence(40, i) + " " + " ".join(hidden) + " " + sentence(40, i + 1)) for i in (500, 600)]
    line, hot = sentence(9, 33), sentence(70, 34)
    for i in range(20, 60):  # lines and passages that many share, repeats within a text
        parts = [sentence(int(rng.integers(20, 90)), 1000 + i)] + [[line] * int(rng.integers(1, 9)), [hot], [hot, sentence(5, i), hot], [" ".join(hot.split()[: int(rng.integers(45, 56))])]][i % 4]
        rows.append((i, "\n".join(parts[j] for j in rng.permutation(len(parts)))))
    for i in range(700, 712):  # one word over and over, and short cycles
        rows.append((i, sentence(20, i) + " " + " ".join(["spam"] * (60 + 13 * (i % 4))) + " " + sentence(9, 35) + " " + " ".join(["one two three"] * (12 + 5 * (i % 5)))))
    fuzzy = {}
    for i in range(60, 140, 2):  # passages with a tenth of the words changed
        passage = sentence(80, 3000 + i).split()
        changed = [w if rng.random() > 0.1 else f"x{rng.integers(99)}" for w in passage]
        rows += [(i, sentence(30, 4000 + i) + " " + " ".join(passage)), (i + 1, " ".join(changed) + " " + sentence(30, 5000 + i))]
        fuzzy[i + 1] = i
    found = substring_dedup.repeated_passages(passage_table(spark, rows)).collect()
    texts = {i: lowered(t) for i, t in rows}
    spans, first = {}, {}
    for r in found:
        a, b = texts[r.doc_id][r.start_word : r.end_word], texts[r.source_id][r.source_start : r.source_end]
        assert r.source_id < r.doc_id and len(a) >= 50 and r.n_same >= 0.8 * max(len(a), len(b)) and r.n_words == len(texts[r.doc_id])
        assert substring_dedup.equal_in_gap(np.array(a), np.array(b)) >= r.n_same
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    for i in sorted(texts):
        for at in range(len(texts[i]) - 49):
            run = tuple(texts[i][at : at + 50])
            if first.setdefault(run, i) < i:
                assert all(any(s <= w < e for s, e in spans[i]) for w in range(at, at + 50)), (i, at)
    assert (600, 500) in {(r.doc_id, r.source_id) for r in found if r.end_word - r.start_word >= 200}
    assert np.mean([(i, j) in {(r.doc_id, r.source_id) for r in found} for i, j in fuzzy.items()]) >= 0.9
    assert not any(i < 17 for i in spans)


def test_both_copies_of_a_passage_go(spark):
    docs = passage_table(spark, [(1, sentence(40, 20) + " " + PASSAGE), (2, PASSAGE + " " + sentence(80, 21) + " " + PASSAGE)])
    found = substring_dedup.repeated_passages(docs)
    assert sorted((r.doc_id, r.source_id, r.start_word, r.end_word) for r in found.collect()) == [(2, 1, 0, 60), (2, 1, 140, 200)]
    assert {r.doc_id: r.text for r in substring_dedup.drop_passages(docs, found).collect()}[2] == sentence(80, 21)


def test_bpe(docs, none):
    rank_path, pattern = registry.ranks()
    encoding = byte_bpe.load_encoding(rank_path, pattern)
    for r in byte_bpe.bpe_digests(docs, rank_path, pattern).collect():
        text = next(t or "" for i, t, *_ in ROWS if i == r.doc_id)
        ids = encoding.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert byte_bpe.bpe_digests(none, rank_path, pattern).count() == 0


def plain_votes(text):
    """The rules' votes, without Spark."""
    text = text or ""
    w = words(text)
    n, chars = len(w), sum(map(len, w))
    windows = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    repeats = len({j for i in range(n - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})
    lines = [x for x in text.split("\n") if words(x)]
    symbols, marked, signs = len(re.findall(r"[#*$%&|<>]", text)), sum(bool(re.search(r"[#*$%&|<>]", x)) for x in w), len(re.findall(r"[!-@\[-`{-~]", text))
    loud, capitals, marks, dup = sum(x.endswith("!!") for x in w), len(re.findall("[A-Z]", text)), text.count("!"), len(lines) - len(set(lines))
    vote = lambda bad, good: -1 if bad else 1 if good else 0
    return (
        vote(100 * symbols > 6 * chars, 100 * symbols <= chars), vote(10 * marked > n, 50 * marked <= n), vote(100 * signs > 9 * chars, 100 * signs <= 6 * chars),
        vote(100 * repeats > 20 * n, 100 * repeats <= 5 * n), vote(2 * dup > len(lines), 10 * dup <= len(lines)), vote(n >= 50 and 10 * len(set(w)) < 4 * n, n < 50 or 2 * len(set(w)) >= n),
        vote(2 * loud > n, 20 * loud <= n), vote(100 * capitals > 40 * chars, 100 * capitals <= 15 * chars), vote(100 * marks > 5 * chars, 100 * marks <= chars),
    )


def test_quality(docs, none):
    for r in quality_rules.quality_verdicts(docs).collect():
        text = next(t or "" for i, t, *_ in ROWS if i == r.doc_id)
        w = words(text)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
    fitted, verdicts = quality_rules.fit_rules(sorted(Counter(plain_votes(t) for _, t, *_ in ROWS).items())), quality_rules.quality_verdicts(docs)
    for r in verdicts.collect():
        text = next(t or "" for i, t, *_ in ROWS if i == r.doc_id)
        quality = quality_rules.quality_of(plain_votes(text), fitted)
        assert math.isclose(r.quality, quality, abs_tol=1e-9) and r.kept == (not r.base_failed and quality >= 0.5)
    kept = quality_rules.keep_quality(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 8, 9, 12}
    assert quality_rules.quality_report(none).count() == 0 and quality_rules.keep_quality(none).count() == 0


def test_quality_is_native(docs):
    plan = quality_rules.quality_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixing(spark, docs, none):
    out = mixing.poisson_mix(docs, {"a": 0.8, "b": 0.1, None: 0.1}, budget=3.0)
    rows = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns and [r.mix_order for r in rows] == sorted(r.mix_order for r in rows)
    assert not any(r.source == "c" for r in rows)
    copies = {}
    for r in rows:
        copies.setdefault(r.doc_id, []).append(r.mix_copy)
    rates = {r.source: r.rate for r in mixing.source_rates(docs, {"a": 0.8, "b": 0.1, None: 0.1}, budget=3.0).collect()}
    assert rates[None] == 0.0 and rates["c"] == 0.0
    for i, _, _, source in ROWS:
        u = int(hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        n, p, total = 0, math.exp(-rates[source]), math.exp(-rates[source])
        while total <= u:
            n += 1
            p *= rates[source] / n
            total += p
        assert sorted(copies.get(i, [])) == list(range(1, n + 1))
    many = spark.range(20000).selectExpr("id AS doc_id", "'text' AS text", "IF(id % 3 = 0, 'x', 'y') AS source")
    mean = mixing.poisson_mix(many, {"x": 0.5, "y": 0.5}, shuffle=False).groupBy("source").count().collect()
    assert all(abs(r["count"] - 10000) < 400 for r in mean)
    assert mixing.poisson_mix(none).count() == 0
    tiny = spark.createDataFrame([(1, "x" * 10, "t"), (2, "y" * 100000, "h")], "doc_id long, text string, source string")
    rate = 100010 * 0.5 / 10
    (row,) = mixing.poisson_mix(tiny, {"t": 0.5, "h": 0.5}).where("source = 't'").select("mix_copies").distinct().collect()
    u, k, total, term = int(hashlib.md5(b"mix:1").hexdigest()[:13], 16) / 2**52, 0, 0.0, -rate
    while (total := total + math.exp(term)) <= u:
        k += 1
        term += math.log(rate / k)
    assert abs(row.mix_copies - k) <= 1


def test_top_k(spark):
    vectors = RNG.integers(-5, 5, (90, 4)).astype(float) / 64
    rows = [(i, [float(v) for v in x], 0, "q") for i, x in enumerate(vectors)] + [(90, None, 0, "q"), (91, [1.0, None, 0.0, 0.0], 0, "q"), (92, [float("nan")] * 4, 0, "q"), (93, [float("inf")] * 4, 0, "q"), (None, [0.0] * 4, 0, "q")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int, cell string")
    whole = cover_tree.quantized(table.union(table.where("vec_id % 3 = 0")))
    found = cover_tree.top_k_inner_product(whole.where("vec_id % 20 = 0"), whole, 20, candidate_block=16, query_block=2)
    ints = np.floor(vectors.astype(np.float32).astype(float) * 64).astype(int)
    expected = {(q, k + 1, j, -s) for q in range(0, 90, 20) for k, (s, j) in enumerate(sorted((-int(ints[q] @ ints[j]), j) for j in range(90) if j != q)[:20])}
    assert {tuple(r) for r in found.collect()} == expected
    few = cover_tree.top_k_inner_product(whole.where("vec_id = 0"), whole.where("vec_id < 3"), 20).collect()
    assert len(few) == 2
    assert cover_tree.top_k_inner_product(whole.limit(0), whole).count() == 0 and cover_tree.top_k_inner_product(whole.limit(3), whole.limit(0)).count() == 0


def test_far_blocks_are_left_out(spark):
    rng = np.random.default_rng(41)
    centres = rng.integers(-4000, 4000, (8, 6))
    vectors = np.concatenate([c + rng.integers(-20, 20, (60, 6)) for c in centres])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, vec array<bigint>")
    found = cover_tree.top_k_inner_product(table.where("vec_id % 9 = 0"), table, 5, candidate_block=20, query_block=10)
    plain = {(q, k + 1, j, -s) for q in range(0, len(vectors), 9) for k, (s, j) in enumerate(sorted((-int(vectors[q] @ vectors[j]), j) for j in range(len(vectors)) if j != q)[:5])}
    assert {tuple(r) for r in found.collect()} == plain
    read = {name: spark.read.parquet(path) for name, path in _scratch(spark).items()}
    assert read["first-pairs"].count() + read["then-pairs"].count() < 0.5 * read["block-pairs"].count()


def _scratch(spark):
    """The newest table of each label in the shared folder."""
    import glob
    import os

    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    found = {}
    for path in sorted(glob.glob(f"{base}/pixelloom-*"), key=os.path.getmtime):
        found[os.path.basename(path).removeprefix("pixelloom-").rpartition("-")[0]] = path
    return found


def test_warc_round_trip(spark):
    long = "é" * 30000
    same = "s" * 1500
    rows = [(1, "http://a/", same), (2, "http://b/\n", same), (3, None, same), (4, "u", None), (5, "u", ""), (6, "u", long), (7, "u", "short"), (8, "u", "short"), (9, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (None, "u", "lost")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit(1))
    found = {r.page_id: r for r in warc.warc_round_trip(pages, segment_bytes=4096, records_per_file=2).collect()}
    assert len(found) == 9
    for i, _, html in rows[:9]:
        raw = (html or "").encode()
        kind, target = ("revisit", 3) if i in (1, 2) else ("response", None)
        r = found[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), kind, target)
        assert r.payload is None if kind == "revisit" else bytes(r.payload) == raw
    twice = warc.warc_round_trip(pages.union(pages).union(spark.createDataFrame([(6, "u", long + "x", 1)], pages.schema)), segment_bytes=4096).collect()
    assert sorted((r.page_id, bytes(r.payload or b"")) for r in twice if r.page_id == 6) == sorted([(6, long.encode())] * 2 + [(6, (long + "x").encode())])
    assert len(twice) == 19 and sum(r.record_type == "revisit" for r in twice) == 4
    broken = warc.read_records(spark, _archives(spark, pages)).where("segment IS NULL OR segment <> 2")
    with pytest.raises(Exception, match="broken segments"):
        warc.reassembled(broken).collect()


def _archives(spark, pages):
    from pixelloom.llm.storage import scratch_path

    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages, path, segment_bytes=4096)
    return path


def test_chat(spark):
    odd = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", None), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, None, None, odd), (4, 1, "assistant", odd), (4, 1, "assistant", odd), (5, 0, "assistant", ""), (None, 0, "user", "lost")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1))
    nodes, leaves = chat_tree.prefix_tree(table)
    out = nodes.orderBy("emit_start").collect()
    assert len(out) == 8 and [n.emit_start for n in out] == [0, *np.cumsum([n.emit_end - n.emit_start for n in out])[:-1].tolist()]
    by = {bytes(n.key): n for n in out}
    for n in out:
        if n.parent is not None:
            p = by[bytes(n.parent)]
            assert p.emit_start < n.emit_start and n.attended_until <= p.attended_until and n.position_start == p.position_start + len(p.segment)
        inside = [m for m in out if n.emit_start <= m.emit_start < n.attended_until]
        ancestry = {bytes(n.key)}
        assert all(bytes(m.key) in ancestry or bytes(m.parent) in ancestry and not ancestry.add(bytes(m.key)) for m in inside)
    found = {r.conv_id: r for r in chat_tree.chat_digests(table).collect()}
    assert set(found) == {1, 2, 3, 4, 5}
    for conv, r in found.items():
        turns = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
    assert chat_tree.chat_digests(table.limit(0)).count() == 0


def test_languages(spark, docs, none):
    rng = np.random.default_rng(12)
    sounds = {"aa": ["ba", "lo", "mi", "ra"], "bb": ["sch", "tz", "ung", "ei"], "cc": ["ção", "nh", "lh", "ões"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[lang], 3)) for _ in range(30)), lang) for i in range(300) for lang in [("aa", "bb", "cc")[i % 3]]]
    rows += [(300, None, "aa"), (301, "123 !!", "bb"), (302, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    found = {r.doc_id: r for r in language_id.held_out_languages(table).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i].held_out == (i in held) for i in range(300))
    assert np.mean([found[i].lang_pred == rows[i][2] for i in held]) > 0.97 and all(0 <= found[i].score <= 1 for i in held)
    assert [found[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3
    assert language_id.held_out_languages(none).count() == 0
    assert {r.lang_pred for r in language_id.held_out_languages(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_ngrams(text):
    """Hashed n-grams of the words of letters, with a blank on either side, without numpy."""
    found = []
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        padded = f" {word} "
        for n in language_id.ORDERS:
            for at in range(len(padded) - n + 1):
                gram = padded[at : at + n]
                if gram.strip() and not (n == 1 and gram == " "):
                    code = n
                    for c in gram:
                        code = ((code ^ ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
                        code ^= code >> 15
                    found.append(code % language_id.FEATURES)
    return found


def test_languages_against_plain_codes(spark):
    rng = np.random.default_rng(14)
    sounds = {"aa": ["ba", "lo", "mi"], "bb": ["sch", "tz", "ung"], "cc": ["ção", "nh", "lh"], "dd": ["ka", "mi", "ung"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[lang], 2)) for _ in range(1 + i % 12)), lang) for i in range(80) for lang in [list(sounds)[i % 4]]]
    rows[7] = (7, "Ba-lo 12 ção! SCH", "aa")
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language_id.held_out_languages(table).collect()}
    languages, counts = sorted(sounds), {}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(plain_ngrams(text))
    share = {}
    for lang in languages:
        total = sum(counts[lang].values()) + language_id.PRIOR * language_id.FEATURES
        share[lang] = lambda f, c=counts[lang], t=total: (c[f] + language_id.PRIOR) / t
    code = language_id.codewords(4)
    sides = [[[lang for lang, sign in zip(languages, code[:, b], strict=True) if sign == s] for s in (1, -1)] for b in range(code.shape[1])]
    weight = lambda b, f: math.log(np.mean([share[x](f) for x in sides[b][0]])) - math.log(np.mean([share[x](f) for x in sides[b][1]]))
    seen = sorted({f for c in counts.values() for f in c})
    weights = {f: [weight(b, f) for b in range(len(sides))] for f in seen}
    rest = [weight(b, next(f for f in range(language_id.FEATURES) if f not in weights)) for b in range(len(sides))]
    n_rest = language_id.FEATURES - len(seen)
    unseen = {lang: share[lang](next(f for f in range(language_id.FEATURES) if f not in weights)) for lang in languages}
    margins = np.array([[code[i, b] * (sum(share[lang](f) * weights[f][b] for f in seen) + n_rest * unseen[lang] * rest[b]) for b in range(len(sides))] for i, lang in enumerate(languages)])
    reliable = np.maximum(margins.min(axis=0), 1e-3)
    scale = 4 / np.median(margins)
    for i, text, _ in rows:
        grams = plain_ngrams(text)
        mean = [sum(weights.get(f, rest)[b] for f in grams) / len(grams) for b in range(len(sides))]
        loss = [sum(r * math.log1p(math.exp(-scale * m * code[k, b])) for b, (r, m) in enumerate(zip(reliable / reliable.sum(), mean, strict=True))) for k in range(4)]
        likely = [math.exp(-3 * (x - min(loss))) for x in loss]
        assert found[i].lang_pred == languages[int(np.argmin(loss))] and math.isclose(found[i].score, max(likely) / sum(likely), rel_tol=1e-4)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(docs, none, order):
    held_ids = [i for i, *_ in ROWS if i is not None and zlib.crc32(str(i).encode()) % 7 == 2]
    train = docs.where(~F.coalesce(F.col("doc_id").isin(held_ids), F.lit(False)))
    model = kneser_ney.train(train, order=order, shard_bytes=100)
    assert model[1] > 40
    found = {r.doc_id: r for r in kneser_ney.score(docs, model, open_files=3).collect()}
    tokens = {i: [*lowered(t), "</>"] for i, t, *_ in ROWS}
    kept = [i for i in tokens if i not in held_ids]
    count = Counter(w for i in kept for w in tokens[i])
    padded = lambda t: ["<>"] * (order - 1) + t
    levels = {order: Counter(tuple(padded(tokens[i])[k : k + order]) for i in kept for k in range(len(tokens[i])))}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    d = {n: [0, *kneser_ney.discounts(Counter(c.values()))] for n, c in levels.items()}
    total, kinds = Counter(), {}
    for c in levels.values():
        for g, n in c.items():
            total[g[:-1]] += n
            kinds.setdefault(g[:-1], Counter())[min(n, 3)] += 1

    def p(g):
        if not g:
            return 1 / (len(count) + 1)
        lower = p(g[1:])
        if not total[g[:-1]]:
            return lower
        n = levels[len(g)][g]
        return max(n - d[len(g)][min(n, 3)], 0) / total[g[:-1]] + sum(d[len(g)][k] * m for k, m in kinds[g[:-1]].items()) / total[g[:-1]] * lower

    context = ("two", "words", "und")[-(order - 1) :]
    assert abs(sum(p((*context, w)) for w in count) + p((*context, "unseen")) - 1) < 1e-9
    size = sum(count.values())
    for i, t in tokens.items():
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[w] > 0 for w in t), size)
        assert math.isclose(r.score, sum(math.log10(p(tuple(padded(t)[k : k + order]))) for k in range(len(t))), rel_tol=1e-9)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (size + len(count) + 1)) for w in t), rel_tol=1e-9)
    if order == 2:
        whole = {r.doc_id: r for r in kneser_ney.held_out_scores(docs).collect()}
        assert all(whole[i].held_out == (i in held_ids) and math.isclose(whole[i].score, found[i].score, rel_tol=1e-9) for i in tokens)
        assert kneser_ney.held_out_scores(none).count() == 0


def test_registry():
    assert [name.split("_")[0] for name in registry.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
