"""The training-data operators against brute force, round trips and held-out accuracy, on small fixtures."""

import random
import re
import zlib

import numpy as np
import pytest

from emberlog.llm import benchmark_decontamination, chat_format, embedding_dedup, language_id, minhash_dedup, packing, quality_classifier, substring_dedup, token_ids, toxicity, url_filter

from ..same import bag

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS = "doc_id long, text string"


def docs(spark, rows, extra=True):
    """Rows as documents; extra columns bear outputs' names."""
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "'x' AS score", "'y' AS node", "1 AS kept") if extra else df


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


# --- near duplicates ---------------------------------------------------------------------------------------------------


def least_reachable(ids, linked):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def near_fixture():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(150)]
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE  two"), (5, " \n"), (6, "one two three"), (7, "ÄB c d e f"), (8, "äb c d e f")]
    for i in range(60):  # a group of copies, from near to far
        copy = list(base)
        for _ in range(i // 4):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((10 + i, " ".join(copy)))
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(40))) for i in range(20)]
    return [*rows, (200, rows[10][1]), (201, " ".join(base * 200)), (None, "x y z a b c"), (None, " ".join(["zz", *base[1:]]))]


@pytest.mark.parametrize("meeting", [1024, 4])
def test_minhash(spark, monkeypatch, meeting):
    monkeypatch.setattr(minhash_dedup, "MEETING", meeting)
    rows = near_fixture()
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = list(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = least_reachable(ids, linked)
    assert {i: (got[i].component_id, got[i].n_shingles, got[i].kept) for i in ids} == {i: (want[i], len(sets[i]), want[i] == i) for i in ids}
    assert got[None].component_id is None and not got[None].kept
    kept = minhash_dedup.keep_one(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(i for i in ids if want[i] == i or not sets[i])
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("block", [1024, 4])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 16))
    x[20:60] = x[0] + rng.normal(size=(40, 16)) * 0.25
    x[60:70] = x[1]
    rows = [(i, [float(v) for v in x[i]], i % 2 if i < 10 else 0) for i in range(120)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [None] * 16, 0), (204, [float(v) for v in x[0]], None), (205, [1.0, 2.0], 0), (206, [1.0, 2.0], 0), (207, [], 0)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    sound = [(i, np.array(v), lab) for i, v, lab in rows if i < 200 or i in (205, 206)]
    cos = lambda a, b: len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93
    linked = [(i, j) for i, a, la in sound for j, b, lb in sound if i < j and la == lb and cos(a, b)]
    want = least_reachable([r[0] for r in rows], linked)
    n = {r[0]: sum(r[0] in p for p in linked) for r in rows}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (n[i], want[i], want[i] == i) for i in n}
    named = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "a"), (3, [1.0, 2.0], "b"), (4, [1.0, 2.0], None)], "vec_id long, embedding array<float>, label string").selectExpr("*", "'x' AS node", "1 AS cell", "2 AS kept")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(named).collect()} == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True)}
    assert embedding_dedup.near_duplicate_vectors(named.limit(0)).count() == 0
    whole = embedding_dedup.nearest_e8(rng.normal(size=(50, 8)) * 3)
    assert np.isin((2 * whole).sum(axis=1) % 4, [0]).all()


# --- text ----------------------------------------------------------------------------------------------------------------


def test_substring(spark):
    passage = "Alpha beta gamma delta epsilon zeta. Eta theta iota kappa lambda mu nu xi omicron pi rho. Sigma tau upsilon phi chi psi omega done."
    rows = [(3, f"first own words here and more {passage} then other words"), (1, f"some start of mine {passage} and an end"), (2, "clean text. Of its own."), (4, None), (5, ""), (6, "clean text. Of its own."), (6, "clean text. Of its own.")]
    got = substring_dedup.remove_copies(docs(spark, rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[1].text == rows[1][1] and by[4].text is None and by[5].text == ""
    assert by[3].text == "first own words here and more then other words"
    (span,) = by[3].removed
    assert rows[0][1][span.start : span.end] == passage and span.kept_in == 1
    assert by[6].text == rows[2][1]  # too short a run
    assert substring_dedup.remove_copies(docs(spark, [])).count() == 0
    assert set(by[3].asDict()) == {"doc_id", "text", "score", "node", "kept", "n_removed", "removed"}


def test_substring_lines(spark):
    hot = "the and attion to thanedble, anea. Eriner thanea."
    rows = [(1, f"own first line here\n{hot}\nmore own words of one"), (2, f"{hot}\nsecond document says something\nno it"), (3, f"third one starts\n{hot.upper()}\nno it\nand ends so"), (4, f"inside a line {hot} it stays"),
            (5, "a b\nc d\n\nlone words of five"), (6, "six begins\n\na b\nc d\n\nx y z"), (7, "seven has a line\na b\nhere")]
    got = {r.doc_id: r.text for r in substring_dedup.remove_copies(docs(spark, rows)).collect()}
    want = dict(rows) | {2: "second document says something\nno it", 3: "third one starts\nno it\nand ends so", 6: "six begins\n\nx y z"}
    assert {i: re.sub(r"\n+", "\n", t).strip() for i, t in got.items()} == {i: re.sub(r"\n+", "\n", t).strip() for i, t in want.items()}


def brute_windows(rows, n=50, own_overlap=False):
    """Of each document, its words (as they stand) in runs of n that an earlier place holds; what a run shares with one it
    overlaps stays where ``own_overlap``."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        w, covered = t.split(), set()
        for k in range(len(w) - n + 1):
            doc, at = seen.setdefault(tuple(w[k : k + n]), (i, k))
            if (doc, at) != (i, k):
                covered |= set(range(max(k, at + n) if own_overlap and doc == i else k, k + n))
        out[i] = covered
    return out


@pytest.mark.parametrize("hot", [1024, 1])  # 1: every anchor goes the way of hot ones
def test_substring_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(8)

    def own(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    passage, long, short = own(60), own(160), own(49)
    edited = [*long[:80], "other", *long[81:]]
    arabic = [chr(0x628 + rng.randrange(20)) + chr(0x628 + rng.randrange(20)) for _ in range(70)]
    plan = {
        1: [*own(30), *passage, *own(20)], 2: long, 3: [*own(7), *arabic, *own(5)], 4: [*own(10), *short, *own(10)],
        11: [*own(13), *passage, *own(40)], 12: [*own(5), *edited, *own(5)], 13: [*own(4), *arabic, *own(3)], 14: [*own(3), *short, *own(6)],
    }
    rows = [(i, " ".join(w)) for i, w in plan.items()]
    want = brute_windows(rows)
    han = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(80))
    rows += [(21, "甲乙丙丁" + han + "戊己"), (22, "子丑" + han + "寅卯辰"), (31, "spam " * 200), (None, " ".join([*own(9), *passage]))]
    got = {r.doc_id: r for r in substring_dedup.remove_copies(docs(spark, rows)).collect()}
    assert [len(want[i]) for i in (11, 12, 13, 14)] == [60, 159, 70, 0]
    for i, w in plan.items():
        assert got[i].text.split() == [x for k, x in enumerate(w) if k not in want[i]]
    assert [(x.kept_in, plan[12][0:5] == rows[5][1][: x.start].split()) for x in got[12].removed][0] == (2, True) and len(got[12].removed) == 2
    assert got[21].text == rows[8][1] and got[22].text == "子丑寅卯辰"
    assert got[31].text.split() == ["spam"] * 50  # the first window stays
    assert len(got[None].text.split()) == 9


def test_substring_brute_force(spark, monkeypatch):
    """Every word of a run of 50 that an earlier place holds goes, and no other, on texts made of shared pieces."""
    monkeypatch.setattr(substring_dedup, "HOT", 6)
    rng = random.Random(3)
    pieces = [[f"p{k}w{rng.randrange(4)}" for _ in range(rng.choice([20, 35, 51, 90, 130]))] for k in range(6)]
    rows = [(i, " ".join(x for _ in range(rng.randrange(1, 5)) for x in [*rng.choice(pieces), *(f"o{rng.randrange(10**9)}" for _ in range(rng.randrange(3)))])) for i in range(60)]
    rows += [(100 + i, "la " * n) for i, n in enumerate((10, 49, 50, 51, 300))] + [(110, rows[5][1]), (5, rows[5][1]), (120, None), (121, "")]
    got = {r.doc_id: r.text for r in substring_dedup.remove_copies(docs(spark, rows), least=10**6).collect()}
    want = brute_windows([(i, t or "") for i, t in dict(rows).items()], own_overlap=True)
    whole = {i for i, t in rows if len((t or "").split()) >= substring_dedup.ALONE_WORDS and t in [u for j, u in rows if j < i]}  # lines that are copies
    for i, t in rows:
        assert (got[i] or "").split() == ([] if i in whole else [x for k, x in enumerate((t or "").split()) if k not in want[i]]), i


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def test_decontamination(spark):
    rng = random.Random(4)
    words = ["a", "b", "c", "é", "7"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 12, 30])))) for i in range(12)] + [(50, None), (51, "Q r-S")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(40)] + [(90, None), (91, ""), (92, "x q R s y")]
    rows += [(100 + i, "zz " + (items[i][1] or "").upper() + " yy" * 700) for i in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for part in (1 << 20, 20):  # one pass, and several
        got = {r.doc_id: r for r in benchmark_decontamination.benchmark_hits(docs(spark, rows), bench, part_bytes=part).collect()}
        for i, t in rows:
            w, found = word_list(t), set()
            hit = [0] * len(w)
            for item, text in items:
                p = word_list(text)
                m = min(10, len(p))
                for k in range(len(w) - m + 1) if m else ():
                    if any(w[k : k + m] == p[j : j + m] for j in range(len(p) - m + 1)):
                        hit[k : k + m] = [1] * m
                        found.add(str(item))
            assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(w), sum(hit), sorted(found))
    none = benchmark_decontamination.benchmark_hits(docs(spark, rows), bench.limit(0))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(rows)


def test_chat_round_trip(spark, duck):
    from pyspark.sql import functions as F

    nasty = ["<|im_end|>", "\\<|", "<\\|x", "<", "|\\\\", None, "é\n<\\/"]
    rows = [(c, t, role, text) for c, text in enumerate(nasty) for t, role in enumerate(["user", "assistant"])] + [(50, None, None, "x"), (50, 0, "us\ner", "<|")]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.select("conv_id", chat_format.read_back(F.col("formatted")).alias("turns")).collect()}
    assert back == {c: [("user", x or ""), ("assistant", x or "")] for c, x in enumerate(nasty)} | {50: [("us\ner", "<|"), ("", "x")]}
    assert {r.conv_id: r.first_bad_turn for r in out.collect()}[50] == 0
    assert bag(chat_format.query(spark, SF).toPandas()) == bag(duck.execute(chat_format.SQL).df())


def test_token_ids():
    import public_tokenizers

    e = token_ids.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Hello world's 123 !!! aaaaaaaa", "<|endoftext|> x", "日本語", "ß É éé ½²", "", None, "It's x_y\ttab\nline ’“”"]
    for _ in range(2):
        assert [x.tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, window = public_tokenizers.path("word_bpe_49k.json"), 64
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["cat", "dogs", "éa", "x1"]) for _ in range(rng.randrange(90)))) for i in range(150)] + [(500, None), (501, ""), (None, "a b"), (7, "again")]
    pieces = packing.pack(docs(spark, rows), path, window).collect()
    tokenizer = Tokenizer.from_file(path)
    want = {}
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(i, []).append(ids)
    for i in set(want) - {7}:
        mine, at = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start), 0
        for p in mine:
            ids = want[i][0][p.start : p.start + p.length]
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids.tobytes())
            at += p.length
        assert at == len(want[i][0]) == mine[0].doc_tokens
    assert sum(p.length for p in pieces) == sum(len(x) for v in want.values() for x in v)
    for s in {p.sequence_id for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == p.padded_to and (at == window or at & (at - 1) == 0)
    assert packing.pack(docs(spark, []), path, window).count() == 0


def test_packing_solver():
    histogram = np.zeros(2048, np.int64)
    histogram[[500, 1548, 700, 648]] = [90, 90, 60, 30]
    columns = packing.combinations(histogram, 2048)
    assert columns.tolist() == [[0, 500, 1548], [648, 700, 700]]
    assert packing.solve_counts(histogram, columns).round().tolist() == [90, 30]
    assert packing.combinations(np.array([0, 0, 2, 0]), 6).tolist() == []  # three would be needed
    assert packing.combinations(np.array([0, 0, 3, 0]), 6).tolist() == [[2, 2, 2]]
    order, counts = packing.round_counts(np.array([0.25, 2.0, 0.25, 0.25, 0.25]))
    assert counts.sum() == 3 and order[0] == 1


def test_packing_share():
    rng = np.random.default_rng(7)
    lengths = np.minimum(2047, 1 + (rng.lognormal(6.4, 0.7, 10_000)).astype(int))
    plan = packing.plan_rests(np.bincount(lengths, minlength=2048))
    assert plan.attrs["solved"] > 0.8 * plan.attrs["full"]
    assert (plan["part_length"] * (plan["high"] - plan["low"])).sum() == lengths.sum()
    assert len(packing.plan_rests(np.zeros(2048, np.int64))) == 0


def test_urls(spark):
    from urllib.parse import urlsplit  # noqa: F401

    urls = ["http://WWW.Example.com/en/1?q", "http://a.example.com/en/x", "http://x.net/fr/", "https://t.com", "http://b.com/#z", None, "nothing", "ftp://u@h.org:80/p", "://", "http://casino-win.example.org/en/7", "http://library.example.org/de/4"]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for i, u in enumerate(urls):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(UPPER)
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule[0])
        assert got[i].verdict == (rule[1] or ("block" if got[i].score >= url_filter.THRESHOLD else "allow"))
    assert got[9].verdict == "block" and got[10].verdict == "allow" and got[5].verdict == "allow"
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


# --- classifiers: held-out accuracy ----------------------------------------------------------------------------------------


def accuracy(spark, query, target):
    got = {r.doc_id: r for r in query(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [x for x in labels if got[x.doc_id].held_out]
    assert all(r.held_out == (crc(i, 3) == 1) and 0 <= r.score <= 1 for i, r in got.items())
    return sum(got[x.doc_id].predicted == x[target] for x in held) / len(held), len(got)


def test_quality(spark):
    share, n = accuracy(spark, quality_classifier.query, "quality")
    assert share >= 0.95 and n == 1000
    model = quality_classifier.Constant(0.5)
    scored = quality_classifier.score_quality(docs(spark, [(1, None), (None, ""), (1, "a b " * 5000)]), model).collect()
    assert [r.score for r in scored] == [0.5] * 3


def test_toxicity(spark):
    share, n = accuracy(spark, toxicity.query, "toxic")
    assert share >= 0.9 and n == 1000
    lexicon = toxicity.fallback()
    low, high, masked, spared = lexicon.score([None, "you cretin bastard twat", "you cr3tin ba5tаrd tw4t", "the bastard file and vermin control"])
    assert high == masked > low and spared == low == lexicon.score([""])[0]
    empty = toxicity.train(docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.weights == lexicon.weights


def test_languages(spark):
    got = {r.doc_id: r for r in language_id.query(spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) >= 0.95
    assert all(got[r.doc_id].held_out == (crc(r.doc_id, 4) == 2) for r in rows)
    some = spark.createDataFrame([(1, "ab cd ef", "xx"), (2, "ab cd", None), (3, None, "xx")], "doc_id long, text string, lang string")
    judged = {r.doc_id: r for r in language_id.identify_language(docs(spark, [(1, None), (2, "12 !"), (3, "ab cd ef"), (4, "")]), language_id.learn_filters(some)).collect()}
    assert [judged[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "xx", "und"]


def test_rare_language(spark):
    rows = [(i, "alpha beta gamma delta", "aa") for i in range(3000)] + [(5000, "zuzu kiki momo", "zz")]
    filters = language_id.learn_filters(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 50)
    assert filters.languages == ["aa", "zz"]
    assert [r.lang_pred for r in language_id.identify_language(docs(spark, [(1, "zuzu momo")]), filters).collect()] == ["zz"]


def test_signs_are_no_letters(spark):
    filters = language_id.learn_filters(spark.createDataFrame([(1, "ab cd ef", "xx")], "doc_id long, text string, lang string"))
    texts = ["— “12” …", "👍 100 %", "日本", "é", "“ab”", ""]
    got = {r.doc_id: r for r in language_id.identify_language(docs(spark, list(enumerate(texts))), filters).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und", "und", "xx", "xx", "xx", "und"] and got[0].score == got[1].score == 0


# --- brute force ---------------------------------------------------------------------------------------------------------

UNSPACED = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"


def plain_cut(rows):
    """`substring_dedup.remove_copies` by dictionaries of tuples: the texts that stay, by id. Ids are distinct."""
    edge = ".,;:!?\"'()[]{}<>|*#&$%-–—…«»“”„‘’"
    seen, out = {}, {}
    for i, text in sorted(rows):
        text = text or ""
        spans = [m.span() for m in re.finditer(f"{UNSPACED}|[^\\s{UNSPACED[1:-1]}]+", text)]
        words = [(text[a:b].lower().strip(edge) or text[a:b].lower()) for a, b in spans]
        n = len(words)
        gaps = [text[0 if k == 0 else spans[k - 1][1] : spans[k][0]] for k in range(n)]
        line = [k for k in range(n) if k == 0 or "\n" in gaps[k]]
        paragraph = [k for k in range(n) if k == 0 or gaps[k].count("\n") > 1]
        unit = [k for k in range(n) if k in line or text[spans[k - 1][1] - 1] in ".!?" or re.match("[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]", text[spans[k][0]])]
        gone = set()

        def copied(kind, a, b):
            key = (kind, *words[a:b])
            return seen.setdefault(key, (i, a)) != (i, a)

        pairs = lambda x: list(zip(x, [*x[1:], n]))
        least = 4 if len(line) > 1 else 6
        run = []
        for a, b in [*pairs(unit), (n, n)]:
            if a < b and copied("unit", a, b):
                run.append((a, b))
                continue
            if run and run[-1][1] - run[0][0] >= 20:
                gone |= set(range(run[0][0], run[-1][1]))
            run = []
        for a, b in pairs(line):
            if b - a >= least and copied("line", a, b):
                gone |= set(range(a, b))
        for a, b in pairs(paragraph):
            if b - a >= least and sum(a <= k < b for k in line) > 1 and copied("paragraph", a, b):
                gone |= set(range(a, b))
        for k in range(n - 49):
            doc, at = seen.setdefault(("window", *words[k : k + 50]), (i, k))
            if (doc, at) != (i, k):
                gone |= set(range(max(k, at + 50) if doc == i else k, k + 50))
        kept, k, last = [], 0, 0
        while k < n:
            if k not in gone:
                k += 1
                continue
            stop = k
            while stop in gone:
                stop += 1
            kept.append(text[last : spans[k][0]])
            last, k = spans[stop - 1][1], stop
        joined = ""
        for part in [*kept, text[last:]]:
            joined += part.lstrip(" \t") if not joined or joined[-1].isspace() else part
        out[i] = text if not gone else joined if text[last:].strip() else joined.rstrip()
    return out


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_substring_against_dictionaries(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents", "/root/testdata/sf0.01").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in substring_dedup.query(spark, "/root/testdata/sf0.01").collect()}
    want = plain_cut(rows)
    assert {i: r.text or "" for i, r in got.items()} == want and any(r.n_removed for r in got.values())
    for i, text in rows:  # the offsets are the original's
        assert sum(x.end - x.start for x in got[i].removed) <= len(text) and all(text[x.start : x.end].strip() for x in got[i].removed)


def plain_attention(model, text):
    """The score of one text, passage by passage and unit by unit."""
    import math

    x, _ = quality_classifier.passages(*quality_bytes(text))
    p = model.p
    hidden, logits = [], []
    for row in x:
        row = [min(6, max(-6, (float(v) - m) / s)) for v, m, s in zip(row, model.mean, model.spread)]
        h = [math.tanh(sum(v * p["E"][k][j] for k, v in enumerate(row)) + p["e"][j]) for j in range(quality_classifier.WIDTH)]
        gate = [math.tanh(sum(v * p["V"][k][j] for k, v in enumerate(h))) / (1 + math.exp(-sum(v * p["U"][k][j] for k, v in enumerate(h)))) for j in range(len(h))]
        hidden.append(h)
        logits.append(sum(g * w for g, w in zip(gate, p["w"])))
    weights = [math.exp(v - max(logits)) for v in logits]
    z = [sum(w * h[j] for w, h in zip(weights, hidden)) / sum(weights) for j in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["c"])) + float(p["b"][0]))))


def quality_bytes(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def test_attention_by_loops(spark):
    model = quality_classifier.train(table(spark, "documents"), table(spark, "labels"))
    assert isinstance(model, quality_classifier.Attention)
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").limit(40).collect()] + [(1000, None), (1001, "word " * 5000)]
    for r in quality_classifier.score_quality(docs(spark, rows), model).collect():
        assert abs(r.score - plain_attention(model, r.text)) < 1e-9
    assert quality_classifier.score_quality(docs(spark, []), model).count() == 0
    empty = quality_classifier.train(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int"))
    assert empty.score(*quality_classifier.passages(*quality_bytes("x"))) == [0.5]


def test_lexicon_by_plain_search(spark):
    lexicon = toxicity.train(table(spark, "documents"), table(spark, "labels"))
    texts = [r.text for r in table(spark, "documents").collect()] + ["", None, "x" * 50_000, "the bastard file"]
    lexicon.exceptions = ("bastard file",)
    lexicon.weights[" bastard "] = 3.0
    for text in texts:
        folded = toxicity.fold(text)
        found = {}
        for entry, weight in lexicon.weights.items():
            at = folded.find(entry)
            while at >= 0:
                found.setdefault(at, []).append((weight, entry))
                at = folded.find(entry, at + 1)
        for phrase in lexicon.exceptions:
            at = folded.find(toxicity.fold(phrase))
            while at >= 0:
                found = {k: v for k, v in found.items() if not at <= k < at + len(phrase) + 2}
                at = folded.find(toxicity.fold(phrase), at + 1)
        assert {k: w for k, (_, w) in lexicon.hits(folded).items()} == {k: max(v)[0] for k, v in found.items()}
    assert toxicity.score_toxicity(docs(spark, []), lexicon).count() == 0
    assert [r.score for r in toxicity.score_toxicity(docs(spark, [(None, "x"), (1, None), (1, None)]), lexicon).collect()] == [lexicon.score([""])[0]] * 3


def test_nothing_by_hand(spark):
    """No host of the pages, and no word that only toxic documents hold, is written down in the modules."""
    from pathlib import Path

    hosts = {h.split("://", 1)[-1].split("/")[0].lower() for h in (r.url for r in table(spark, "pages", "/root/testdata/sf0.1").select("url").collect()) if h}
    source = Path(url_filter.__file__).read_text()
    names = {h.removeprefix("www.").removeprefix("m.").removeprefix("blog.").split(".")[0] for h in hosts}
    assert not [n for n in names if len(n) > 4 and n != "example" and n in source]
    assert not {n for n, _, _ in url_filter.labelled_urls()} & hosts
    labelled = table(spark, "documents", "/root/testdata/sf0.1").join(table(spark, "labels", "/root/testdata/sf0.1"), "doc_id").selectExpr("toxic", "explode(array_distinct(split(lower(text), '[^a-z]+'))) AS word")
    planted = labelled.groupBy("word").agg({"toxic": "sum", "*": "count"}).where("`count(1)` >= 50 and `sum(toxic)` >= 0.95 * `count(1)`").collect()
    assert planted and not {r.word for r in planted} & set(" ".join((*toxicity.FALLBACK, *toxicity.EXCEPTIONS)).split())


def test_urls_by_loops(spark):
    model = url_filter.default_model()
    urls = [r.url for r in table(spark, "pages").limit(60).collect()] + ["http://" + "a" * 20_000 + ".org/x", "x://é.de/ü"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS score", "'r' AS rule")
    for r in url_filter.judge_urls(pages).collect():
        z = model.intercept
        for salt, part in enumerate((r.host, r.path)):
            padded = b"^" + part.encode() + b"$"
            grams = [(g, padded[k : k + g]) for g in url_filter.GRAMS for k in range(len(padded) - g + 1)] if part else []
            for g, gram in grams:
                code = 1000 * salt + g
                for byte in gram:
                    code = (code * 257 + byte) % (1 << 64)
                place = int(url_filter.mix(np.array([code], np.uint64))[0]) & ((1 << url_filter.BITS) - 1)
                z += model.weights[place] / len(grams) ** 0.5
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9


def test_urls_held_out():
    """Names of the table that the model hasn't seen."""
    urls = url_filter.labelled_urls()
    part = lambda host: zlib.crc32(re.sub(r"^(www|m|blog)\\.", "", host).split(".")[0].encode()) % 5
    right = 0
    for f in range(5):
        model = url_filter.UrlModel.train([u for u in urls if part(u[0]) != f])
        left = [u for u in urls if part(u[0]) == f]
        scores = model.scores(url_filter._column([u[0] for u in left]), url_filter._column([u[1] for u in left]))
        right += sum((s >= url_filter.THRESHOLD) == bool(u[2]) for s, u in zip(scores, left))
    assert right / len(urls) > 0.9


def test_languages_by_sets(spark):
    """Predictions by plain sets of n-grams in place of the filters."""
    rows = table(spark, "documents", "/root/testdata/sf0.01").select("doc_id", "text", "lang").collect()
    counts, texts = {}, {}
    for r in rows:
        if crc(r.doc_id, 4) != 2 and r.lang is not None and r.text is not None:
            texts[r.lang] = texts.get(r.lang, 0) + 1
            for g in set(plain_grams(r.text)):
                counts.setdefault(r.lang, {}).setdefault(g, 0)
                counts[r.lang][g] += 1
    shares = {lang: {g: n / texts[lang] for g, n in c.items() if n >= min(language_id.LEAST, texts[lang])} for lang, c in counts.items()}
    most = {}
    for c in shares.values():
        for g, x in c.items():
            most[g] = max(most.get(g, 0), x)
    held = {lang: {g for g, x in c.items() if x >= language_id.SHARE * most[g]} for lang, c in shares.items()}
    got = {r.doc_id: r.lang_pred for r in language_id.query(spark, "/root/testdata/sf0.01").collect()}
    same = 0
    for r in rows:
        hits = {lang: sum(g in held[lang] for g in plain_grams(r.text or "")) for lang in sorted(held)}
        same += got[r.doc_id] == ("und" if not any(map(str.isalpha, r.text or "")) else max(hits, key=hits.get))
    assert same >= 0.995 * len(rows)
    assert language_id.identify_language(docs(spark, []), language_id.Filters.build({}, {})).count() == 0


def plain_grams(text):
    raw = text.encode()
    folded = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in raw)
    folded = re.sub(b" +", b" ", folded)
    return [folded[k : k + 4] for k in range(len(folded) - 3)]


def test_chat_cases(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b")]
    some = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS formatted", "1 AS turns")
    (r,) = chat_format.format_chats(some).collect()
    assert r.conv_id == 1
    assert chat_format.format_chats(some.limit(0)).count() == 0


# --- pipeline --------------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    """Every stage against brute force, each on what the one before it kept."""
    import corpus_pipeline as p
    import public_tokenizers
    from tokenizers import Tokenizer

    stages, df = dict(p.STAGES), table(spark, "documents")
    rows = {r.doc_id: r.text for r in df.collect()}

    def step(name):
        out = stages[name](spark, df, SF).cache()
        assert out.columns == df.columns
        return out, {r.doc_id: r.text for r in out.collect()}

    model = quality_classifier.train(df, table(spark, "labels"))
    df, got = step("quality_classifier")
    rows = {i: t for i, t in rows.items() if plain_attention(model, t) >= 0.5}
    assert got == rows and rows
    df, got = step("minhash_near_dedup")
    sets = {i: shingles(t) for i, t in rows.items()}
    near = least_reachable(list(rows), [(a, b) for a in rows for b in rows if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    rows = {i: t for i, t in rows.items() if near[i] == i or not sets[i]}
    assert got == rows
    df, got = step("substring_dedup")
    cut = plain_cut(list(rows.items()))
    rows = {i: t if cut[i] == (t or "") else cut[i] for i, t in rows.items() if cut[i] == (t or "") or cut[i].strip()}
    assert got == rows
    df, got = step("benchmark_decontamination")
    windows = set()
    for r in table(spark, "benchmark").collect():
        w = word_list(r.text)
        windows |= {tuple(w[k : k + min(10, len(w))]) for k in range(len(w) - min(10, len(w)) + 1)} if w else set()
    runs = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + m]) in windows for m in runs for k in range(len(w) - m + 1))
    rows = {i: t for i, t in rows.items() if not hit(word_list(t))}
    assert got == rows and rows
    pieces = stages["packing"](spark, df, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in rows.items():
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for piece in sorted((x for x in pieces if x.doc_id == i), key=lambda x: x.start):
            assert piece.start == at and piece.ids_crc32 == zlib.crc32(ids[at : at + piece.length].tobytes())
            at += piece.length
        assert at == len(ids)


def test_pipeline_cases(spark):
    """Nulls, ties, repeated rows, an empty table and clashing names, at every stage."""
    import corpus_pipeline as p

    passage = " ".join(f"Word{k} said" for k in range(60)) + "."
    rows = [(1, passage), (1, passage), (2, passage + " More here."), (3, None), (4, ""), (None, passage), (None, None), (5, "short"), (5, "Another text of the same number, which says little.")]
    some = docs(spark, rows).selectExpr("*", "1L AS n_hit", "'t' AS text_key", "2L AS __doc", "'c' AS __copies", "3.5 AS hashes")
    for name, stage in p.STAGES:
        out = stage(spark, some, SF)
        n = out.count()
        none = stage(spark, some.limit(0), SF)
        assert none.count() == 0
        if name != "packing":
            assert out.columns == none.columns == some.columns and 0 < n <= len(rows), name
        else:
            assert n >= len(rows)


