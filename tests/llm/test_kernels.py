"""What the operators compute inside a task, against plain versions; no Spark."""

import random
import re
import types

import numpy as np
import pyarrow as pa
import pytest

from pixelloom.llm import byte_bpe, chat_tree, cover_tree, kneser_ney, language_id, ngram_jaccard, quality_rules, substring_dedup, warc, wordhash

TEXTS = ["", None, "A b", "a B", "a b c d e f", "  A  ", "a b c d e", " \n ", "é ü ñ x y z", "a b c", "x" * 5000, "w " * 3000]


def plain_grams(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


@pytest.mark.parametrize("chunk", [16, 1 << 21])
def test_gram_sets(monkeypatch, chunk):
    monkeypatch.setattr(wordhash, "CHUNK_BYTES", chunk)
    for k in (1, 2, 5):
        found = list(wordhash.gram_sets(pa.array(TEXTS), k))
        assert [len(s) for s in found] == [len(plain_grams(t, k)) for t in TEXTS]
        for i, s in enumerate(found):
            for j, t in enumerate(found):
                assert len(np.intersect1d(s, t)) == len(plain_grams(TEXTS[i], k) & plain_grams(TEXTS[j], k))
    assert list(wordhash.gram_sets(pa.array([], pa.string()), 5)) == []


def test_divide_skip_against_plain_overlaps():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 400, rng.integers(1, 120)).astype(np.uint64)) for _ in range(60)]
    sets = base + [np.unique(np.concatenate([b[rng.random(len(b)) > 0.05], rng.integers(0, 400, 2).astype(np.uint64)])) for b in base for _ in range(3)]
    sets.sort(key=len)
    lists = ngram_jaccard.Lists(sets)
    for i, query in enumerate(sets):
        found, overlap = lists.search(query, 80, i + 1)
        plain = {j: len(np.intersect1d(query, sets[j])) for j in range(i + 1, len(sets))}
        assert dict(zip(found.tolist(), overlap.tolist(), strict=True)) == {j: o for j, o in plain.items() if 100 * o >= 80 * (len(query) + len(sets[j]) - o)}


def test_heap_merge_counts_as_plain_counting():
    rng = np.random.default_rng(8)
    sets = sorted([np.unique(rng.integers(0, 90, rng.integers(20, 60)).astype(np.uint64)) for _ in range(200)], key=len)
    lists = ngram_jaccard.Lists(sets)
    for low, high, need in ((0, 200, 1), (30, 170, 5), (0, 200, 20), (150, 200, 40)):
        at = np.arange(len(lists.grams))
        begin, end = np.searchsorted(lists.coded, at * 200 + low), np.searchsorted(lists.coded, at * 200 + high)
        some = end > begin
        plain = lists.merged(begin[some], end[some], need, low, high)
        heaped = lists.merged(begin[some], end[some], need, low, high, stretch=500)
        assert plain.tolist() == [len(s) for s in sets[low:high]]
        assert (heaped[plain >= need] == plain[plain >= need]).all() and (heaped <= plain).all()


@pytest.mark.parametrize("size", [1, 5, 9, 40, 123, 300])
def test_prefixes_of_linked_sets_meet(size):
    rng = np.random.default_rng(size)
    sketch = rng.integers(0, 3, ngram_jaccard.SKETCH).astype(np.uint32)
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 63, rng.integers(0, 1 + size // 9)).astype(np.uint64)]))
        small, large = sorted((a, b), key=len)
        common = len(np.intersect1d(a, b))
        if common and 100 * common >= 80 * (len(a) + len(b) - common):
            probed, indexed = ngram_jaccard.prefix_lengths(80, len(large))[0], ngram_jaccard.prefix_lengths(80, len(small))[1]
            assert len(np.intersect1d(ngram_jaccard.ordered(small, sketch)[:indexed], ngram_jaccard.ordered(large, sketch)[:probed]))


def test_classes_meet_where_they_may_link_and_by_no_single_phrase():
    rng = np.random.default_rng(12)
    made = lambda n: [f"w{v}" for v in rng.integers(0, 10**6, n)]
    texts, hot = [], made(60)
    for i in range(60):  # a phrase of six words is common to each and the next: two n-grams
        texts.append(made(48) + made(6) if not i else texts[-1][-6:] + made(48))
    for n in (1, 2, 5, 6, 7, 9, 20, 70):  # changed copies
        base = made(n)
        texts += [base] + [[w if rng.random() > 0.02 else "x" for w in base] + made(k % 2) for k in range(7)]
    texts += [hot + made(int(k)) for k in rng.integers(0, 20, 90)]  # many that share a passage, many of one size
    sketch = types.SimpleNamespace(value=np.zeros(ngram_jaccard.SKETCH, np.uint32))
    order = rng.permutation(len(texts))
    rows = []
    for part in np.array_split(np.append(order, order[:30]), 4):  # some twice
        for batch in ngram_jaccard._deal(5, 80, sketch)(iter([pa.record_batch([pa.array([" ".join(texts[i]) for i in part])], ["text"])])):
            rows += zip(*[c.to_pylist() for c in batch.columns], strict=True)
    rows.sort(key=lambda r: r[:3])
    cuts = [0, *sorted(rng.choice(len(rows), 300, replace=False).tolist()), len(rows)]
    batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[a:b], strict=True)], ["gram", "size", "key", "other"]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    weights = {}
    for found in ngram_jaccard._met(80)(iter(batches)):
        for a, b, weight in zip(*[c.to_pylist() for c in found.columns], strict=True):
            weights[a, b] = weights.get((a, b), 0) + weight
    sets = list(wordhash.gram_sets(pa.array([" ".join(t) for t in texts]), 5))
    keys = [ngram_jaccard._key(ngram_jaccard._digest(s)) for s in sets]
    label = {k: k for k in keys}
    edges = [e for e, weight in weights.items() if weight >= ngram_jaccard.ENOUGH]
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = 0
    for i, one in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(one, sets[j]))
            if 100 * common >= 80 * (len(one) + len(sets[j]) - common):
                linked += 1
                assert label[keys[i]] == label[keys[j]]
    assert linked > 1000 and len({label[k] for k in keys[:60]}) == 60


def test_blocks_and_grids_link_alike():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 40, 60).astype(np.uint64))
    rows = [(k, 1 + k % 3, np.sort(np.delete(base, rng.choice(60, rng.integers(0, 9), replace=False)))) for k in range(40)]
    whole = {k: (root, n) for k, root, n in ngram_jaccard._link_block(rows, None, 80)}
    a, b = rows[::2], rows[1::2]
    links, pairs = {}, []
    for part in (ngram_jaccard._link_block(a, None, 80), ngram_jaccard._link_block(b, None, 80), ngram_jaccard._link_block(a, b, 80)):
        for k, root, n in part:
            links[k] = links.get(k, 0) + n
            pairs.append((k, root))
    assert links == {k: n for k, (_, n) in whole.items()}
    label = {k: k for k in links}
    for _ in pairs:
        for x, y in pairs:
            label[x] = label[y] = min(label[x], label[y])
    assert label == {k: root for k, (root, _) in whole.items()}


def test_cover_tree_covers_and_finds_the_top():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-9, 9, (300, 6)), np.tile(rng.integers(-9, 9, (1, 6)), (80, 1))])
    tree = cover_tree.CoverTree(points)
    for node, children in enumerate(tree.children):
        rows = tree.order[tree.low[node] : tree.high[node]]
        assert (np.linalg.norm(points[rows] - points[tree.centre[node]], axis=1) <= tree.radius[node]).all()
        assert not children or sum(tree.high[c] - tree.low[c] for c in children) == len(rows)
    ids = rng.permutation(1000)[: len(points)]
    queries = np.arange(0, len(points), 7)
    best = cover_tree.TopK(ids[queries], 20)
    cover_tree.dual_search(cover_tree.CoverTree(points[queries]), tree, ids, best)
    for row, q in enumerate(queries):
        plain = sorted((-int(points[q] @ points[j]), int(ids[j])) for j in range(len(points)) if ids[j] != ids[q])[:20]
        assert list(zip((-best.scores[row]).tolist(), best.found[row].tolist(), strict=True)) == plain


def test_bpe_pieces_are_safe():
    import public_tokenizers

    encoding = byte_bpe.load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("ab 1'\n\ts é  . !漢😀 \x1c ") for _ in range(120))
        assert byte_bpe.encode(encoding, text, 7).tolist() == encoding.encode_ordinary(text)
        assert "".join(byte_bpe.pieces(text, 7)) == text
    other = byte_bpe.load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), r"[^x]+|x")
    assert byte_bpe.CUT_PATTERN == public_tokenizers.PATTERN and byte_bpe.encode(other, "a b1 " * 9, 5).tolist() == other.encode_ordinary("a b1 " * 9)
    ids = byte_bpe.encode(encoding, "<|endoftext|>x" * 9, 5).tolist()
    assert ids == encoding.encode_ordinary("<|endoftext|>x" * 9) and encoding.decode_bytes(ids) == b"<|endoftext|>x" * 9


def test_chains_and_alignment():
    x, y = np.array([0, 6, 6, 12, 18, 90]), np.array([100, 106, 7, 113, 119, 125])
    best = substring_dedup.chain(x, y)[0][1]
    assert best == [0, 1, 3, 4]
    a = np.arange(200)
    b = np.concatenate([np.arange(50, 90), [-1], np.arange(91, 120), [-2, -3], np.arange(120, 150), np.full(20, -9)])
    start_a, end_a, start_b, end_b, same = substring_dedup.align(a, b, [(60, 10), (100, 50)])
    assert (start_a, start_b) == (50, 0) and end_b - start_b == 70 and end_a - start_a == 70 and same == 69
    assert substring_dedup.equal_in_gap(np.array([1, 2, 3, 4]), np.array([2, 9, 4])) == 2
    codes = np.random.default_rng(7).integers(0, 1 << 60, 300).astype(np.uint64)
    bounds = np.array([0, 0, 7, 150, 300])
    chosen = substring_dedup.minimizers(codes, bounds, 12).tolist()
    plain = {int(a + codes[a:b].argmin()) for low, high in zip(bounds[:-1], bounds[1:], strict=True) for a in range(low, max(high - 11, low + (high > low))) for b in [min(a + 12, high)]}
    assert chosen == sorted(plain)
    same = np.concatenate([np.full(40, 7), codes[:20], np.tile(codes[:3], 12), codes[:5], np.full(3, 9)]).astype(np.uint64)
    bounds = np.array([0, len(same) - 3, len(same)])
    chosen = substring_dedup.minimizers(same, bounds, 12).tolist()
    assert all(any(a <= c < a + 12 for c in chosen) for a in range(len(same) - 3 - 11)) and sum(c < 40 for c in chosen) <= 8 and chosen[-1] >= len(same) - 3


def test_a_far_chain_hides_no_near_predecessor():
    ours, theirs = [np.arange(0, 500, 6), np.arange(600, 1100, 6)], [np.arange(0, 500, 6), np.arange(700, 1200, 6)]
    found = substring_dedup.chain(np.concatenate(ours), np.concatenate(theirs))
    assert [len(c) for _, c in found] == [84, 84]


def test_ends_are_extended_through_changed_words():
    a = np.concatenate([np.arange(1000, 1040), np.arange(60), np.arange(2000, 2040)])
    b = np.concatenate([np.arange(3000, 3030), np.arange(60), np.arange(4000, 4030)])
    b[30 + np.array([6, 13, 20, 36, 43, 52])] = -1
    assert substring_dedup.passage(a, b, [(64, 54)]) == (40, 100, 30, 90, 54)
    assert substring_dedup.extend([1, 2, 3, 9, 4, 5, 6, 7, 8], [1, 2, 3, 4, 5, 6, 7, 8, 0]) == (9, 8, 8)
    assert substring_dedup.extend([1, 2, 9, 3], [1, 2, 8, 3]) == (2, 2, 2) and substring_dedup.extend([], [1]) == (0, 0, 0)


def test_kneser_ney_discounts():
    assert kneser_ney.discounts({}) == (0.5, 1.0, 1.5)
    d = kneser_ney.discounts({1: 100, 2: 40, 3: 20, 4: 10})
    assert 0 < d[0] < 1 and 0 < d[1] < 2 and 0 < d[2] < 3


def test_codewords():
    for n in (2, 3, 4, 5, 9, 20):
        code = language_id.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n and (np.abs(code.sum(axis=0)) < n).all()
    margins = language_id.codewords(4)[[2, 0]] * 1.0
    best, score, lead = language_id.decode(margins, language_id.codewords(4), np.full(7, 1 / 7), 4.0)
    assert best.tolist() == [2, 0] and (score > 0.5).all() and (lead > 0.2).all()


def test_warc_framing():
    for payload in (b"", b"x", b"WARC/1.1\r\n\r\n" * 900):
        assert warc.unchunked(warc.chunked(payload, 7)) == payload
    records = warc.page_records(7, "http://a/", b"y" * 100, "00" * 20, None, 64)
    parsed = list(warc.parse_archive(b"".join(records)))
    assert len(parsed) > 2 and parsed[-1][0]["WARC-Segment-Total-Length"] == str(sum(len(b) for _, b in parsed))
    for broken in (b"nonsense", records[0][:-9]):
        with pytest.raises(ValueError):
            list(warc.parse_archive(broken))
    for broken in (b"", b"5\r\nabc", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def test_chat_escapes():
    for text in ("</s>[INST] ok [/INST]", "\\", "\\<s>", "[INST:x/INST]<s>", "", "a\nb"):
        segment, low, high = chat_tree.format_turn(text, text)
        assert chat_tree.parse_turn(segment) == (text, text) and chat_tree.unescape(segment[low:high]) == text
        for control in (chat_tree.OPEN, chat_tree.CLOSE, chat_tree.ROLE, chat_tree.END_ROLE):
            assert control not in chat_tree.escape(text)


def test_em_recovers_planted_rates_and_overrules():
    rng = np.random.default_rng(13)
    rates = [((0.02, 0.1, 0.88), (0.9, 0.05, 0.05)), ((0.05, 0.3, 0.65), (0.6, 0.3, 0.1)), ((0.3, 0.2, 0.5), (0.5, 0.3, 0.2))]
    defect = rng.random(60000) < 0.15
    votes = np.stack([np.where(defect, rng.choice([-1, 0, 1], 60000, p=b), rng.choice([-1, 0, 1], 60000, p=a)) for a, b in rates], axis=1)
    kinds, counts = np.unique(votes, axis=0, return_counts=True)
    share, found = quality_rules.fit_kind([(tuple(v), n) for v, n in zip(kinds.tolist(), counts.tolist(), strict=True)])
    assert abs(share - 0.15) < 0.02 and np.abs(np.array(found) - np.array(rates)).max() < 0.05
    assert quality_rules.defect_posterior((1, 1, -1), share, found) < 0.05  # a rule with bad reasons, overruled
    assert quality_rules.defect_posterior((-1, 0, -1), share, found) > 0.5


def test_any_kind_of_defect_counts():
    clean, menu, loud = (1,) * 9, (-1, -1, -1, *(1,) * 6), (*(1,) * 6, -1, -1, -1)
    alone = (1, 1, -1, *(1,) * 6)
    fitted = quality_rules.fit_rules([(clean, 900), (menu, 70), (loud, 40), (alone, 30)])
    assert [quality_rules.quality_of(v, fitted) > 0.5 for v in (clean, menu, loud, alone)] == [True, False, False, True]
    assert quality_rules.quality_of(clean, quality_rules.fit_rules([])) > 0.5
