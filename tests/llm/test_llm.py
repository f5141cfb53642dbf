"""The operators against brute force, exact round trips and held-out accuracy on small fixtures."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from meshlore.llm import bpe, common, components, decontaminate, exact_dedup, exchange, language, pitman_yor, quality, queries, similarity, substring_dedup, toxicity, training_order
from meshlore.llm.blocks import blocks, words
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCABULARY = "the of and to in that with from this thing order ready stone river light paper window garden winter summer table silver copper engine letter market doctor".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", "", ",", "er", "ing", "s"]) for _ in range(n))


def frame(spark, rows, schema=DOCS, parts=3):
    width = schema.count(",") + 1
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema).repartition(parts)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a"), (6, "A  b"), (7, "a b"), (None, "a"), (8, "x" * 300_000), (9, "y " * 60_000), (10, "é\x00ß 漢字 😀"), (10, "é\x00ß 漢字 😀")]


def test_words_match_split():
    texts = ["", "  a b\n", "Éa\x0bB  c", "x" * 5000, "one two one", "\t", "a"]
    column = pa.array(texts + [None])
    seen = {}
    for block in blocks(column, 64):
        found = words(block)
        for i in range(len(block)):
            own = [x for x in re.split(rb"[\x20\x09-\x0d]+", (texts + [""])[block.first + i].encode()) if x]
            lo, hi = found.first[i], found.first[i + 1]
            assert hi - lo == len(own)
            for h, w in zip(found.hash[lo:hi].tolist(), own, strict=True):
                low = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
                assert seen.setdefault(low, h) == h
    assert len(set(seen.values())) == len(seen)


def test_exact_dedup(spark):
    rows = ODD + [(20 + i, "same text\n here") for i in range(50)] + [(100, "same text  here")]
    got = exact_dedup.exact_dedup(frame(spark, rows), digests=True).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, keep[norm(t)], len(groups[norm(t)]), i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.full_hash).hex()) for r in got) == want
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_clashing_and_repeated_rows(spark):
    docs = frame(spark, [(1, "a"), (1, "a"), (2, "a"), (3, "b"), (4, "c\ne"), (4, "c e"), (None, "d"), (None, "d"), (None, "a")])
    for name in ("full_hash", "keep_id", "kept", "group_size", "id", "row", "inside", "key", "bucket", "bits", "__keep", "__size", "__salt"):
        docs = docs.withColumn(name, F.lit(name))
    kept = exact_dedup.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text.split()[0]) for r in kept.collect()) == [("1", "a"), ("3", "b"), ("4", "c"), ("None", "d")]
    assert exact_dedup.exact_dedup(docs).where("kept").count() == 7
    assert exact_dedup.distinct_documents(docs.limit(0)).count() == 0


def test_key_sets_join_what_is_too_large_for_bitmaps(spark, monkeypatch):
    rows = [(i % 40, f"text {i % 25}") for i in range(200)] + [(100 + i, f"lone {i}") for i in range(50)]
    want = sorted(tuple(r) for r in exact_dedup.exact_dedup(frame(spark, rows)).drop("full_hash").collect())
    monkeypatch.setattr(common, "MOST_BITS", 1)
    assert sorted(tuple(r) for r in exact_dedup.exact_dedup(frame(spark, rows)).drop("full_hash").collect()) == want


def test_bpe_against_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    own, library = bpe.tokenizer(path), Tokenizer.from_file(path)
    r = random.Random(5)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "'s", "'ll", "1", "½", "漢", "😀", "\xa0", "\x85", "\x1c", ".", "<|endoftext|>", "_", "́", "\x00", "ther", "tion"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(3000)] + ["".join(r.choice("etaoinshrdlu") for _ in range(n)) for n in (513, 514, 1025, 20_000)] + ["z" * 3000, "ab" * 2000, prose(1, 500)]
    for text, ids in zip(texts, own.encode_many(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)
    assert own.decode(np.array([161, 50256, 99999], "<u4").tobytes()) == library.decode([161, 50256, 99999], skip_special_tokens=False)
    rows = bpe.round_trip(frame(spark, ODD).withColumn("ids", F.lit("clash")), path).collect()
    assert len(rows) == len(ODD) and all((x.text or "") == x.decoded for x in rows)
    assert bpe.encode(frame(spark, []), path).count() == 0


def test_segment_tree_against_plain_merging():
    own = bpe.tokenizer(queries.tokenizer_path())
    rank = lambda a, b: int(own.ranks(np.array([a]), np.array([b]))[0])
    r = random.Random(3)
    pieces = ["".join(r.choice("therinonat ") for _ in range(r.randint(1, 25))).encode() for _ in range(60)]
    for piece, ids in zip(pieces, own.merge_many(pieces), strict=True):
        plain = [int(own.byte_ids[b]) for b in piece]
        while len(plain) > 1:
            best = min(((rank(a, b), i) for i, (a, b) in enumerate(zip(plain, plain[1:], strict=False)) if rank(a, b) >= 0), default=None)
            if best is None:
                break
            plain[best[1] : best[1] + 2] = [int(own.merged[best[0]])]
        assert np.frombuffer(ids, "<u4").tolist() == plain


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", (text or "").lower()) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else (frozenset([tuple(w)]) if w else frozenset())


def near_rows():
    rows = [(i, prose(i, 60)) for i in range(60)]
    base = prose(999, 120).split()
    for k in range(40):  # near copies with a replaced word each
        w = list(base)
        w[(7 * k) % 120] = f"changed{k}"
        rows.append((200 + k, " ".join(w)))
    rows += [(300 + k, prose(7, 60).upper()) for k in range(5)]
    return rows + [(400, None), (401, ""), (402, "one two"), (403, "One  two"), (None, prose(1, 60))]


def test_jaccard_join(spark):
    rows = near_rows()
    got = {(r.doc_id): r for r in similarity.jaccard_join(frame(spark, rows)).collect() if r.doc_id is not None}
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    texts = {i: tuple((t or "").lower().split()) for i, t in rows if i is not None}
    rep = {}
    for i in sorted(texts):
        rep.setdefault(texts[i], i)
    reps = [i for i in rep.values() if sets[i]]
    links = {i: {j for j in reps if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in reps}
    for i, s in sets.items():
        own = rep[texts[i]] if s else i
        seen, todo = {own}, [own]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert (got[i].text_id, got[i].class_id, got[i].n_links) == (own, min(seen), len(links.get(own, ())))
    assert similarity.jaccard_join(frame(spark, [])).count() == 0
    kept = similarity.representatives(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i in sets if got[i].class_id == i)


def test_jaccard_blocks_lose_no_link(spark, monkeypatch):
    rows = near_rows()
    whole = sorted(tuple(r) for r in similarity.jaccard_join(frame(spark, rows)).collect() if r.doc_id is not None)
    monkeypatch.setattr(similarity, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(similarity, "GROUP_BLOCK", 500)
    monkeypatch.setattr(similarity, "GROUP_MEMBERS", 7)
    assert sorted(tuple(r) for r in similarity.jaccard_join(frame(spark, rows)).collect() if r.doc_id is not None) == whole


def test_jaccard_clashing_columns_and_text_ids(spark):
    docs = frame(spark, near_rows())
    want = sorted(str(r.doc_id) for r in similarity.representatives(docs).collect())
    for name in ("__bucket", "__bits", "__gone", "id", "class_id", "row", "inside", "bucket", "bit", "component", "key"):
        docs = docs.withColumn(name, F.lit(name))
    kept = similarity.representatives(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == want
    with pytest.raises(TypeError, match="integer"):
        similarity.jaccard_join(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_intersections_of_a_block_are_bounded():
    import tracemalloc

    r = np.random.default_rng(1)
    sets = [np.unique(np.append(np.arange(9, dtype=np.uint64), r.integers(100, 1 << 40, 2).astype(np.uint64))) for _ in range(2 * similarity.GROUP_MEMBERS)]
    tracemalloc.start()
    both = similarity._intersections(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert both[0, 1] >= 9 and peak < 200e6


def test_bayesian_bound():
    need = similarity.least_matches()
    assert list(need) == list(range(16, 97, 16)) and all(0 < need[n] < 0.8 * n for n in need)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    for i in (n for n in near if near[n] != {n}):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[i] == min(seen)


def test_decontamination(spark):
    items = [(0, prose(50, 40)), (1, prose(51, 15)), (2, "a b c"), (3, None), (4, prose(52, 7)), (None, prose(53, 30))]
    w0 = items[0][1].split()
    swapped = " ".join("other" if i % 5 == 2 else w for i, w in enumerate(w0))
    docs = [(1, prose(60, 80)), (2, prose(61, 20) + " " + items[0][1].upper() + " " + prose(62, 20)), (3, prose(63, 10) + " " + swapped + " " + prose(64, 10)), (4, items[1][1]), (5, " ".join(w0[:6]) + " " + prose(65, 50)), (6, None), (7, ""), (8, "q " + items[4][1] + " q"), (9, items[5][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(frame(spark, docs), bench).collect()}
    assert got == {(2, 0), (3, 0), (4, 1), (8, 4), (9, None)}
    assert sorted(r.doc_id for r in decontaminate.clean(frame(spark, docs), bench).collect()) == [1, 5, 6, 7]
    blocked = {(h[0]) for i in decontaminate.indexes(bench, block_words=20) for b in blocks(pa.array([t or "" for _, t in docs]), 1 << 30) for h in i.overlaps(words(b))}
    assert blocked == {1, 2, 3, 7, 8}
    assert decontaminate.find(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontaminate.find(frame(spark, []), bench).count() == 0


def plain_overlaps(text, item):
    """Most equal words of a stretch, over all diagonals on which a seed fits."""
    w, v = (text or "").lower().split(), (item or "").lower().split()
    n, best = len(v), 0
    for start in range(-len(v) + 1, len(w)):
        equal = {j: w[start + j] == v[j] for j in range(n) if 0 <= start + j < len(w)}
        masks = decontaminate.MASKS if n >= 10 else [*[m for m in decontaminate.MASKS if len(m) <= n], "1" * n]
        if not any(all(b == "0" or equal.get(j + k) for k, b in enumerate(m)) and j + len(m) - 1 in equal and j in equal for m in masks for j in equal):
            continue
        run, lowest, gain, stretch, at = 0, 0, 0, 0, 0
        matched, first = 0, 0
        for j in sorted(equal):
            run += 1 if equal[j] else -1
            matched += equal[j]
            if run - lowest > gain:
                gain, stretch = run - lowest, matched - first
            if run <= lowest:
                lowest, first, at = run, matched, j
        best = max(best, stretch)
    return best if n and best >= min(13, n, max(5, math.ceil(0.8 * n))) else 0


def test_decontamination_against_brute_force(spark):
    r = random.Random(8)
    small = "a b c d e f".split()
    items = [(i, " ".join(r.choice(small) for _ in range(r.choice([0, 1, 2, 4, 6, 9, 12, 30])))) for i in range(25)] + [(30, "x " * 40), (31, "a b " * 20)]
    docs = []
    for i in range(60):
        own = [r.choice(small) for _ in range(r.randrange(40))]
        own += items[r.randrange(len(items))][1].split()
        docs.append((i, " ".join(r.choice(small) if r.random() < 0.1 else x for x in own)))
    docs += [(100, "x " * 300), (101, "b a " * 60), (102, "x " * 20)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {(d, i): n for d, t in docs for i, u in items if (n := plain_overlaps(t, u))}
    got = {(x.doc_id, x.item_id): x.words_equal for x in decontaminate.find(frame(spark, docs).withColumn("item_id", F.lit(1)), bench).collect()}
    assert got == want and len(want) > 100


def test_decontamination_of_repeated_words():
    index = decontaminate.Index.build([(1, "x " * 100), (2, "y z " * 50)])
    text = pa.array(["x " * 1_000_000, "y z " * 50_000])
    found = [hit for b in blocks(text, 1 << 30) for hit in index.overlaps(words(b))]
    assert found == [(0, 0, 0, 100, 100), (1, 1, 0, 100, 100)]


def labelled(n):
    docs, labels = [], []
    for i in range(n):
        toxic, poor = i % 4 == 0, i % 5 == 0
        w = prose(i, 60).split()
        if poor:
            w = [f"{x}%%%" for x in w]
        if toxic:
            w[20] = ["idiot", "qwexo" + prose(i, 1)[:2], "sc0m"[0:2] + "um"][i // 4 % 3]
            w[40] = "qwexo" + random.Random(i).choice(["ta", "li", "ra"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(not poor), int(toxic)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = labelled(600)
    d, lab = frame(spark, docs + [(9001, None), (9002, "")]), frame(spark, labels, "doc_id bigint, quality int, toxic int")
    lexicon = toxicity.fitted(d, lab)
    assert any(t.startswith("qwex") for t in lexicon.terms)
    got = {r.doc_id: r.score for r in toxicity.score(d.withColumn("score", F.lit("clash")), lexicon).collect()}
    wrong = [i for i, _, t in labels if (got[i] >= 0.5) != bool(t)]
    assert len(wrong) <= 6 and got[9001] < 0.5 and got[9002] < 0.5
    found = lambda t: lexicon.matches(toxicity.fold(t))
    assert found("What an 1d10t! An ıdіоt.") == {"idiot": 2} and found("empty the trash can") == {} and found("idiotic trashy") == {}
    assert toxicity.fitted(d.limit(0), lab.limit(0)).terms and toxicity.score(d.limit(0), lexicon).count() == 0


def test_quality(spark):
    docs, labels = labelled(600)
    d, lab = frame(spark, docs + [(9001, None), (9002, "")]), frame(spark, labels, "doc_id bigint, quality int, toxic int")
    model = quality.fitted(d, lab)
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    held = [r.doc_id for r in d.where(common.crc_mod(F.col("doc_id"), 5) == 0).select("doc_id").collect() if r.doc_id < 9000]
    assert sum((got[i] >= 0.3) != bool(labels[i][1]) for i in held) <= len(held) // 20
    assert got[9001] == got[9002] and all(0 <= s <= 1 for s in got.values())
    assert quality.fitted(d.limit(0), lab.limit(0)).scores(next(blocks(pa.array(["x"])))).tolist() == pytest.approx([0.5])


def test_language(spark):
    train = [(i, prose(i, 80), "en") for i in range(20)] + [(100 + i, " ".join("der die und nicht ein zeit haus schnee" .split()[(i * k) % 8] for k in range(1, 60)), "de") for i in range(20)]
    model = language.fitted(frame(spark, train))
    de = train[25][1]
    pages = [(1, "http://a.example.de/x", f'<html lang="de"><nav>the of and</nav><p>{de}</p>'), (2, "https://b.example.com/", f"<p>{prose(5, 50)}</p>"), (3, None, None), (4, "http://a.example.de/y", ""), (5, "http://[bad", "<html lang=en>")]
    pages += [(10 + i, "http://a.example.de/z", f"<html lang='de'>{train[20 + i][1]}") for i in range(10)]
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(pages, "page_id bigint, url string, html string"), model).collect()}
    assert got[1].lang == "de" and got[2].lang == "en" and got[4].lang == "de" and got[4].text_lang is None and len(got) == len(pages)
    assert got[3].lang is not None and got[5].declared == "en" and all(0 < r.probability <= 1 for r in got.values())
    empty = language.fitted(frame(spark, []))
    assert language.identify(spark.createDataFrame(pages, "page_id bigint, url string, html string"), empty).where("lang IS NULL").count() == len(pages)


def test_language_against_brute_force(spark):
    r = random.Random(6)
    german = "der die und nicht ein zeit haus schnee mit dem".split()
    text = lambda lang, n: prose(r.randrange(10**6), n) if lang == "en" else " ".join(r.choice(german) for _ in range(n))
    model = language.fitted(frame(spark, [(i, text("en" if i % 2 else "de", 60), "en" if i % 2 else "de") for i in range(40)]))
    pages = []
    for i in range(120):
        lang, host = r.choice(["en", "de"]), r.choice(["a.one.de", "b.one.de", "c.two.com", "two.com", None])
        mark = r.choice(["", f' lang="{lang}"', " lang=en-GB"])
        pages.append((i, host and f"http://{host}/{i}", f"<html{mark}><p>{text(lang, r.choice([0, 1, 3, 40]))}</p></html>"))
    pages.append((7, pages[7][1], pages[7][2]))
    got = sorted((x.page_id, x.lang, x.probability) for x in language.identify(spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit(1)), model).collect())
    seen = []
    for i, url, html in pages:
        words_of, declared = language.scanned(html)
        like, n = model.likelihoods([words_of])
        soft = np.exp(like[0] - like[0].max())
        seen.append((i, *language.address(url), declared, like[0], soft / soft.sum() if n[0] else np.zeros(2)))
    everything = sum(x[6] for x in seen)
    total = everything.sum() + 2
    want = []
    for i, host, domain, suffix, declared, like, own in seen:
        by = lambda k, value: sum((x[6] for x in seen if value is not None and x[k] == value), np.zeros(2))  # noqa: B023, E731
        prior = (everything + 1) / total
        for counts, weight in ((by(2, domain), language.DOMAIN_WEIGHT), (by(1, host), language.HOST_WEIGHT)):
            less = np.maximum(counts - own, 0)
            prior = (less + prior * weight) / (less.sum() + weight)
        logs = like + np.log(prior)
        for k, value in ((4, declared), (3, suffix)):
            if value is not None:
                less = np.maximum(by(k, value) - own, 0)
                logs = logs + np.log((less + language.VALUE_WEIGHT * (less.sum() + 1) / (total + 1)) / (everything + language.VALUE_WEIGHT))
        p = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        want.append((i, model.languages[int(p.argmax())], p.max()))
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in sorted(want)], rel=1e-6)


def test_markup_is_scanned_once():
    import time

    begin = time.perf_counter()
    for piece in ("<script ", "<script>", "<!-- ", "<", "<html ", "<div class='ad'>", "</nav ", "<html lang", "&amp"):
        language.scanned(piece * 300_000)
    assert time.perf_counter() - begin < 20
    assert language.scanned("<HTML xml:lang='de-AT'><!-- a < b --><script>x<y</Script >eins<NAV>two</nav><div class=\"x ad\">three</div> vier &lt; <b>five")[1] == "de"
    assert language.scanned("<script>x<y</script>eins<nav>two</nav><div class='ad'>three</div>vier<header>open")[0].split() == ["eins", "vier", "open"]


def test_pitman_yor_counts_and_probabilities(spark):
    import zlib

    rows = [(i, prose(i % 17, 40)) for i in range(80)] + [(200, None), (201, ""), (202, "zzz qqq"), (None, "the of")]
    got = {r.doc_id: r for r in pitman_yor.score_texts(frame(spark, rows)).collect()}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    token = lambda t: [x for x in re.split(r"[\x20\x09-\x0d]+", (t or "").lower()) if x] + [None]
    c = Counter(w for i, t in rows if not held(i) for w in token(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(token(t)), sum(c[w] > 0 for w in token(t)), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in token(t)))
        assert r.score < 0 and math.isfinite(r.score)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    assert pitman_yor.score_texts(frame(spark, [])).count() == 0


def test_pack():
    a = {"key": np.sort(np.random.default_rng(1).integers(0, 2**63, 100).astype(np.uint64)), "x": np.arange(100, dtype=np.uint32), "none": np.zeros(0, np.int64)}
    b = exchange.unpack(exchange.pack(a))
    assert all((a[k] == b[k]).all() and a[k].dtype == b[k].dtype for k in a)


def plain_repeats(rows, n=50):
    """For each id its words inside passages of n words or more that a document of a smaller id has."""
    grams = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            grams[g] = min(grams.get(g, i), i)
    out = {}
    for i, t in rows:
        w = (t or "").split()
        inside = {k + j for k in range(len(w) - n + 1) if grams[tuple(w[k : k + n])] < i for j in range(n)}
        if inside:
            out[i] = (len(inside), " ".join(x for k, x in enumerate(w) if k not in inside))
    return out


def test_substring_dedup_against_brute_force(spark):
    r = random.Random(4)
    passages = [prose(900 + k, n) for k, n in enumerate([40, 48, 49, 50, 50, 51, 52, 53, 60, 75, 120, 300])]
    rows = []
    for i in range(150):
        parts = [prose(i, r.randrange(5, 60))]
        for _ in range(r.randrange(3)):
            parts += [f"before{i}.{len(parts)}", r.choice(passages), f"after{i}.{len(parts)}", prose(5000 + r.randrange(10**6), r.randrange(1, 30))]
        rows.append((i, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, "odd" + passages[5]), (202, passages[3] + "odd " + passages[6]), (203, passages[9][10:]), (204, passages[9]), (205, None), (206, "")]
    rows += [(300, prose(1, 8000)), (301, prose(2, 100) + " " + prose(1, 8000)[3000:9000])]
    want = plain_repeats(rows)
    docs = frame(spark, rows, parts=5)
    got = {x.doc_id: x for x in substring_dedup.repeats(docs).collect()}
    assert {i: x.repeated_words for i, x in got.items()} == {i: n for i, (n, _) in want.items()}
    clash = docs.withColumn("spans", F.lit("spans")).withColumn("row", F.lit(1)).withColumn("id", F.lit(2)).withColumn("sha", F.lit(3))
    left = substring_dedup.deduplicated(clash)
    assert left.columns == clash.columns
    assert {x.doc_id: " ".join((x.text or "").split()) for x in left.collect()} == {i: want[i][1] if i in want else " ".join((t or "").split()) for i, t in rows}


def test_substring_dedup_of_odd_rows(spark):
    text = prose(50, 400)
    rows = [(1, text), (1, text), (None, text), (None, prose(51, 100)), (None, prose(51, 100)), (7, "z" * 300_000), (8, "z" * 300_000 + " " + text)]
    got = {x.doc_id: x.repeated_words for x in substring_dedup.repeats(frame(spark, rows)).collect()}
    assert got == {None: 400, 8: 400}
    assert substring_dedup.deduplicated(frame(spark, rows)).count() == len(rows) and substring_dedup.deduplicated(frame(spark, [])).count() == 0
    with pytest.raises(TypeError, match="integer"):
        substring_dedup.repeats(frame(spark, rows).withColumn("doc_id", F.lit("a")))


def test_no_repeats(spark):
    assert substring_dedup.repeats(frame(spark, [])).count() == 0


def test_gear_hash_is_the_rolling_one():
    data = np.frombuffer(prose(1, 50).encode(), np.uint8)
    h, rolled = 0, substring_dedup.gear_hash(data)
    for i, b in enumerate(data):
        h = ((h << 1) + int(substring_dedup._GEAR[b])) & 0xFFFFFFFF
        assert h & 0xFFFF == int(rolled[i]) & 0xFFFF


def test_feistel():
    for n in (1, 2, 3, 100, 4097):
        order = training_order.Feistel(n, 7)
        slots = order.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and order.sequence(slots).tolist() == list(range(n))


def test_training_order(spark, tmp_path):
    docs = frame(spark, [(i, prose(i, 40)) for i in range(50)] + [(60, None), (61, "")])
    path = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    table = training_order.token_table(docs, path)
    plan = training_order.write(table, str(tmp_path / "shards"), length=64, per_shard=5)
    rows = training_order.records(spark, str(tmp_path / "shards"), plan).collect()
    assert sorted(r.slot for r in rows) == list(range(plan.sequences)) and all(len(r.ids) == 128 for r in rows)
    by_sequence = sorted((int(s), r.ids) for r in rows for s in training_order.Feistel(plan.sequences).sequence(np.array([r.slot])))
    stream = np.frombuffer(b"".join(i for _, i in by_sequence), "<u2")
    assert (stream[plan.tokens :] == training_order.END_ID).all()
    encode = training_order.encoding(path).encode_ordinary
    want = Counter(tuple(encode(r.text or "")) for r in docs.collect())
    ends = np.flatnonzero(stream[: plan.tokens] == training_order.END_ID)
    assert Counter(tuple(stream[a:b].tolist()) for a, b in zip([0, *(ends[:-1] + 1)], ends, strict=True)) == want
    # A missing shard is written again, whole ones are left alone.
    files = sorted((tmp_path / "shards").glob("part-*"))
    files[1].unlink()
    training_order.write(table, str(tmp_path / "shards"), length=64, per_shard=5)
    again = training_order.records(spark, str(tmp_path / "shards"), plan).collect()
    assert sorted((r.slot, bytes(r.ids)) for r in again) == sorted((r.slot, bytes(r.ids)) for r in rows)
    # A shard cut short is replaced, one that is there twice too; the manifest is all a reader needs.
    files = sorted((tmp_path / "shards").glob("part-*"))
    files[2].write_bytes(files[2].read_bytes()[: 2 * plan.stride])
    (tmp_path / "shards" / files[3].name.replace("-c000", "-c001")).write_bytes(files[3].read_bytes())
    training_order.write(table, str(tmp_path / "shards"), length=64, per_shard=5)
    again = training_order.records(spark, str(tmp_path / "shards")).collect()
    assert sorted((r.slot, bytes(r.ids)) for r in again) == sorted((r.slot, bytes(r.ids)) for r in rows)
    for other in ({"key": 5}, {"length": 32}):
        with pytest.raises(ValueError, match="another stream"):
            training_order.write(table, str(tmp_path / "shards"), **{"length": 64, "per_shard": 5} | other)
    with pytest.raises(ValueError, match="another stream"):
        training_order.write(training_order.token_table(docs.where("doc_id <> 3"), path), str(tmp_path / "shards"), length=64, per_shard=5)
    training_order.write(training_order.token_table(docs.limit(0), path), str(tmp_path / "none"))
    assert training_order.records(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE"]
    out = corpus_pipeline.run(spark, sf).collect()
    assert len({r.doc_id for r in out}) == len(out) < docs.count() and all(r.round_trip for r in out)


def test_pipeline_keeps_what_brute_force_keeps(spark, tmp_path):
    """Every stage on a fixture, against a plain version of it on the stage's own input."""
    import corpus_pipeline

    base, labels = labelled(400)
    items = [(i, prose(7000 + i, 20 + i)) for i in range(6)]
    rows = list(base)
    rows += [(1000 + i, rows[i][1].replace(" ", "  ") if i % 2 else rows[i][1]) for i in range(0, 40)]
    near = prose(8000, 150).split()
    rows += [(1100 + k, " ".join(f"other{k}" if j == 7 * k % 150 else w for j, w in enumerate(near))) for k in range(25)]
    rows += [(1200 + i, prose(8100 + i, 30) + " " + items[i % 6][1].upper() + " " + prose(8200 + i, 30)) for i in range(18)]
    rows += [(1300, None), (1301, ""), (1301, ""), (1302, "x"), (1303, "q " * 20_000)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages, kept, docs = dict(corpus_pipeline.STAGES), {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept[name] = docs.collect()
    ids = {name: sorted(r.doc_id for r in own) for name, own in kept.items()}
    text = {name: {r.doc_id: r.text or "" for r in own} for name, own in kept.items() if name != "BPE"}

    toxic = {i for i, _, t in labels if t}
    gone = {i for i, _ in rows} - set(ids["toxicity"])
    # A copy of a toxic text is toxic too; a text that another has copied has the copy's judgement.
    assert len(gone ^ (toxic | {1000 + i for i in toxic if i < 40})) <= 4

    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t)
    first = {}
    for i in ids["toxicity"]:
        first.setdefault(norm(text["toxicity"][i]), i)
    assert ids["exact dedup"] == sorted(first.values())

    own = text["exact dedup"]
    sets = {i: shingle_set(t) for i, t in own.items()}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert ids["n-gram Jaccard join"] == sorted(set(group.values())) and len(set(group.values())) < len(group) - 20

    own = text["n-gram Jaccard join"]
    clean = sorted(i for i, t in own.items() if len(t) > 10_000 or not any(plain_overlaps(t, u) for _, u in items))
    assert ids["benchmark decontamination"] == clean and len(clean) < len(own) - 15

    assert ids["BPE"] == clean and all(r.round_trip for r in kept["BPE"]) and stages.keys() == kept.keys()


def test_every_query_has_its_columns(spark):
    assert sorted(queries.QUERIES) == sorted({f"op{n}_{x}" for n, x in [(1, "language_id"), (2, "pitman_yor"), (3, "substring_dedup"), (4, "quality"), (5, "decontamination"), (6, "training_order"), (7, "exact_dedup"), (8, "toxicity"), (9, "bpe"), (10, "jaccard_join")]})
    want = {"op2_pitman_yor": {"held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}, "op4_quality": {"held_out", "score", "predicted"}, "op7_exact_dedup": {"keep_id", "group_size", "kept", "text_sha256"}, "op8_toxicity": {"held_out", "score", "predicted"}, "op9_bpe": {"n_tokens", "ids_sha256", "decoded_sha256"}}
    for name, columns in want.items():
        assert columns | {"doc_id"} <= set(queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns)
