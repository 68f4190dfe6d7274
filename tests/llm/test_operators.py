"""Each operator on a fixture of awkward rows against brute force, and on the small tables."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heredium.llm import counts, decontaminate, fingerprint, fixity, jaccard, packing, passages, pii, quality, queries, tokenfiles, tokens
from tests.conftest import SF
from tools.check_oracle import rows as normal

LONG = " ".join(f"w{i % 97}x{i}" for i in range(9000))
PHRASE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, "a b c d e f g h i j k l m n o p q r s t", "en", "s"), (2, "a b c d e f g h i j k l m n o p q r s t", "en", "s"),
    (3, "a b c d e f g h i j k l m n o p q r s z", None, "s"), (4, None, "en", None), (5, "", "en", "s"), (None, "no id here", "de", "s"),
    (6, f"before it {PHRASE} after it", "en", "s"), (7, f"{PHRASE} tail", "en", "s"), (8, LONG, "en", "big"), (9, "tick tock " * 60, "en", "s"),
    (10, "tiny", "fr", "s"), (10, "tiny", "fr", "s"), (11, "  spaced \t out\nlines  ", "fr", "s"), (12, f"é ñ {PHRASE.upper()}", "es", "s"), (5, "other text under id five", "en", "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """The fixture with extra columns named like columns the operators use."""
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({n: F.lit(7) for n in ("k1", "class", "bin", "anchor", "hash", "own", "shard", "label", "length", "tokens", "rep", "start")}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(t):
    return (t or "").encode().split()


def test_passages(docs, none, monkeypatch):
    texts = [r[1] for r in ROWS]
    seen = Counter(tuple(w[i: i + 35]) for w in map(words, texts) for i in range(len(w) - 34))
    want = []
    for (doc, t, *_) in ROWS:
        w = words(t)
        cut = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i: i + 35])] > 1:
                cut[i: i + 35] = [True] * 35
        want.append((doc, len(w), sum(cut), b" ".join(x for x, c in zip(w, cut) if not c).decode()))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    for hot in (passages.HOT, 1):                       # the second: every anchor is dealt over shards
        monkeypatch.setattr(passages, "HOT", hot)
        assert sorted((tuple(r) for r in passages.deduplicated(docs).collect()), key=key) == sorted(want, key=key)
    assert sum(x[2] for x in want) > 200
    assert passages.deduplicated(none).count() == 0


def linked(rows):
    sets = [jaccard.shingles_of(t or "") for _, t in rows]
    same = [words(t) for _, t in rows]
    n, root = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if same[a] == same[b] or both and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                n[a], n[b] = n[a] + 1, n[b] + 1
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return n, root


def test_jaccard(docs, none):
    every = jaccard.join(docs).collect()                 # repeated rows and ids, a null id, null and empty texts
    n, root = linked([(r[0], r[1]) for r in ROWS])
    assert Counter((r.doc_id, r.n_links) for r in every) == Counter((r[0], n[i]) for i, r in enumerate(ROWS))
    for i, r in enumerate(ROWS):
        if r[0] in (1, 2, 3, 6, 7, 8):
            assert {g.class_id for g in every if g.doc_id == r[0]} == {ROWS[root[i]][0]}
    assert jaccard.join(none).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect())
    assert (True, 2) not in ids and ids.count((True, 10)) == 1 and (False, 0) in ids


def test_jaccard_large_group_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):                                 # near copies, cut into several blocks
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 4)):
            w[k] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "BLOCK", 40)
    got = {r.doc_id: r for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n, root = linked(rows)
    assert [got[i].n_links for i in range(150)] == n and [got[i].class_id for i in range(150)] == root
    assert sum(n) > 1000


def test_quality(spark, docs, none):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(d, labels)
    held = quality.scored(d, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert len(held) > 10 and sum((r.score >= quality.BAR) == (r.quality == 1) for r in held) >= 0.85 * len(held)
    assert {zlib.crc32(str(r.doc_id).encode()) % 5 for r in held} == {0}
    s = quality.scored(docs, model).collect()
    assert len(s) == len(ROWS) and all(0 <= r.score <= 1 for r in s)
    assert len({r.score for r in s if r.doc_id == 4}) == 1
    blank = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.scored(docs, blank).collect()} == {0.5}
    assert quality.scored(none, model).count() == 0
    assert quality.accepted(docs, blank).columns == docs.columns and quality.accepted(docs, blank).count() == len(ROWS)


def test_fingerprints(docs, none, monkeypatch):
    order = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda x: (x[0] is None, -(x[0] or 0)))
    for size in (2048, 3, 1):                            # the last: ids held by several rows and null ids have ranges of their own
        monkeypatch.setattr(fingerprint, "ROWS", size)
        got = fingerprint.with_next(docs).collect()
        assert len(got) == len(ROWS)
        followers = {}
        for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
            followers.setdefault((i, t), []).append(n)
        for r in got:                                    # rows of one id may follow each other in either order
            if Counter(x[0] for x in order)[r.doc_id] == 1 and r.doc_id not in (6, 11):
                assert followers[(r.doc_id, r.text)] == [r.next_text]
        assert len({tuple(r.sketch) for r in got if r.doc_id in (1, 2)}) == 1
        assert all(r.sketch for r in got if r.text)
    assert fingerprint.with_next(none).count() == 0
    s = docs.where("doc_id in (6, 8)").select("doc_id", fingerprint.sketch(F.col("text")).alias("s"))
    a, b = s.where("doc_id = 8").select(F.col("s").alias("a")), s.where("doc_id = 6").select(F.col("s").alias("b"))
    row = a.crossJoin(b).select(fingerprint.containment(F.col("b"), fingerprint.merge(F.col("a"), F.col("b"))).alias("c"), F.size("a").alias("n")).first()   # one row each
    assert row.c == 1.0 and len(LONG) / 10 < row.n < len(LONG) / 6


def runs_of(t):
    return {t[i: i + 12] for i in range(len(t) - 11)} or ({t} if t else set())


def test_fingerprint_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op4_fingerprints"](spark, SF).collect()}
    texts = dict(duckdb.connect().sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    order = sorted(texts, reverse=True)
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    error = {1000: [], 200: [], 0: []}
    by_text = {}
    for i, n in zip(order, order[1:] + order[:1], strict=True):
        m = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - m] + texts[n][:m]
        assert got[i].n_chars == len(texts[i]) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = runs_of(texts[i]), runs_of(edited), runs_of(texts[n])
        at = next(k for k in error if len(texts[i]) >= k)
        error[at] += [abs(got[i].near_edited - alike(a, b)), abs(got[i].near_next - alike(a, c)) if min(len(texts[i]), len(texts[n])) >= at else 0.0]
        assert by_text.setdefault(texts[i], got[i].fingerprint) == got[i].fingerprint
        assert len(got[i].fingerprint) / 16 < 0.2 * len(a) + 12          # one in eight, not all
    assert np.mean(error[1000]) < 0.03 and np.mean(error[200]) < 0.06 and np.mean(error[0]) < 0.2, {k: np.mean(v) for k, v in error.items() if v}


def test_fingerprints_of_short_texts(spark):
    texts = [f"s{k}" + "abcdefgh"[k % 8] * (12 + k % 30) for k in range(60)]
    rows = [(k, t, f"{t} and then {LONG[:20000]}") for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "k long, a string, b string").withColumns({"sa": fingerprint.sketch(F.col("a")), "sb": fingerprint.sketch(F.col("b"))})
    d = d.withColumns({"c": fingerprint.containment(F.col("sa"), F.col("sb")), "m": fingerprint.merge(F.col("sa"), F.col("sb")), "l": fingerprint.likeness(F.col("sa"), F.col("sa"))})
    got = d.select("c", "l", (F.col("m") == F.col("sb")).alias("union")).collect()
    assert all(r.c in (None, 1.0) and r.l in (None, 1.0) and r.union for r in got)
    assert any(r.c is None for r in got) and any(r.c == 1.0 for r in got)


def test_token_files(spark, docs, none, tmp_path):
    path, vocab = f"file://{tmp_path}/ids", tokens.vocabulary("byte_bpe_50k.json")
    tokenfiles.write(docs, path, vocab, part=3000)
    got = tokenfiles.read(spark, path).orderBy("start").collect()
    t = tokens.tokenizer(vocab)
    at, want = 0, Counter()
    for r in ROWS:
        want[(r[0], tuple(t.encode(r[1] or "", add_special_tokens=False).ids + [2]))] += 1
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x or 0))
    tokenfiles.write(none, f"{path}-none", vocab)
    assert tokenfiles.read(spark, f"{path}-none").count() == 0


def test_token_files_refuse_large_ids(docs, tmp_path):
    with pytest.raises(Exception, match="65,536 and above"):
        tokenfiles.write(docs, f"file://{tmp_path}/large", tokens.vocabulary("byte_bpe_50k.json"), end=70000)


def test_rollups(spark, docs, none, tmp_path):
    vocab = {"v1": tokens.vocabulary("word_bpe_49k.json")}
    c = counts.token_counts(docs, vocab)
    store = counts.Store(spark, f"file://{tmp_path}/rollup")
    assert store.totals().count() == 0
    assert store.commit("1", counts.inserts(c)) and not store.commit("1", counts.inserts(c))
    first = {tuple(r[k] for k in counts.KEYS): tuple(r[k] for k in counts.SUMS) for r in store.totals().collect()}
    t = tokens.tokenizer(vocab["v1"])
    want = Counter()
    for _, text, lang, source in ROWS:
        want[(source, lang, "v1")] += len(t.encode(text or "", add_special_tokens=False).ids)
    assert {k: v[1] for k, v in first.items()} == dict(want) and sum(v[0] for v in first.values()) == len(ROWS)
    long = c.where("tokens > 100").withColumns({"new_tokens": F.lit(100), "new_chars": F.col("chars")})
    for _ in range(2):
        store.commit("2", counts.deletes(c.where("doc_id = 10")), counts.revisions(long))
    store.commit("3", counts.inserts(counts.token_counts(none, vocab)))
    after = {tuple(r[k] for k in counts.KEYS): tuple(r[k] for k in counts.SUMS) for r in store.totals().collect()}
    assert after[("s", "fr", "v1")][0] == 1 and after[("big", "en", "v1")] == (1, 100, len(LONG))
    # A write that broke off has no mark: it does not count, and the batch can be sent again.
    (tmp_path / "rollup" / "2" / "_SUCCESS").unlink()
    assert store.batches() == ["1", "3"]
    store.commit("2", counts.deletes(c.where("doc_id = 10")), counts.revisions(long))
    assert {tuple(r[k] for k in counts.KEYS): tuple(r[k] for k in counts.SUMS) for r in store.totals().collect()} == after


def test_rollup_query_equals_a_recount(spark, docs, tmp_path):
    at = f"file://{tmp_path}/sf"
    extra = [(90, "write to someone.else@mail.example.com or +1 (555) 010 2345 today", "en", "s"), (91, "card 4111 1111 1111 1111 " * 400, "en", "big"), (7, "a@b.cd is toxic", "en", "s")]
    docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string")).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(10, 1), (7, 1), (8, 0)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    want = Counter()
    for name in ("byte_bpe_50k", "word_bpe_49k"):
        t = tokens.tokenizer(tokens.vocabulary(f"{name}.json"))
        for i, text, lang, source in [*ROWS, *extra]:
            text = pii.redact(text or "")
            n = len(t.encode(text, add_special_tokens=False).ids)
            want.update({(source, lang, name, k): 0 if i in (7, 10) else v for k, v in (("docs", 1), ("tokens", n), ("chars", len(text or "")))})
    got = {(*(r[k] for k in counts.KEYS), s): r[s] for r in counts.op6_token_rollups(spark, at).collect() for s in counts.SUMS}
    assert got == dict(want)


def check_packing(got, capacity):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs, none):
    vocab = tokens.vocabulary("word_bpe_49k.json")
    got = packing.packed(docs, capacity=256).collect()
    check_packing(got, 256)
    t = tokens.tokenizer(vocab)
    want = Counter()
    for r in ROWS:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at: at + 256]
            want[(r[0], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert packing.packed(none).count() == 0


def test_packing_query_is_near_the_bound(spark):
    got = queries.QUERIES["op7_best_fit_packing"](spark, SF).collect()
    assert check_packing(got, 4096) <= -(-sum(r.length for r in got) // 4096) + 1


def test_personal_data(docs, none):
    got = pii.find(docs.withColumn("text", F.when(F.col("doc_id") == 1, "ping 10.1.1.1, x@y.org").otherwise(F.col("text")))).collect()
    assert len(got) == len(ROWS)
    one = next(r for r in got if r.doc_id == 1)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone, one.spans) == (1, 1, 0, 0, "ip:5:13,email:15:22")
    assert one.base_sha256 == hashlib.sha256(one.spans.encode()).hexdigest()
    assert all(r.spans == "" for r in got if r.doc_id != 1)
    assert pii.find(none).count() == 0
    red = pii.redacted(docs)
    assert red.columns == docs.columns and red.where("text is null").count() == 1


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "body " * (i % 5)) for i in range(60)] + [(None, None, None), (7, "http://x/7", "body " * 2)], "page_id long, url string, html string")
    other = pages.where("page_id is null or page_id <> 20").withColumn("html", F.when(F.col("page_id") == 3, "Body " * 3).otherwise(F.col("html")))
    got = {r.page_id: r.status for r in fixity.audit(pages, other).collect()}
    assert got[3] == "corrupt" and got[20] == "missing" and got[2] == "ok" and got[None] == "ok" and {got[i] for i in range(21, 60)} == {"moved"}
    back = {r.page_id: r.status for r in fixity.audit(other, pages).collect()}
    assert back[20] == "extra"
    none = pages.limit(0)
    assert {r.status for r in fixity.audit(none, pages).collect()} == {"extra"}


def test_fixity_null_and_negative_ids(spark, monkeypatch):
    steps, cut = [], fixity.cut

    def counted(df):                                     # a tree that never closes stops here
        steps.append(1)
        assert len(steps) < 40
        return cut(df)

    monkeypatch.setattr(fixity, "cut", counted)
    ids = [None, None, -30000, -1024, -1, 0, 5, 1023, 1024, 40000]
    pages = spark.createDataFrame([(p, "u", f"body {i}") for i, p in enumerate(ids)], "page_id long, url string, html string")
    other = pages.where("html <> 'body 0' and html <> 'body 9'").withColumn("html", F.when(F.col("page_id") == -1, "Body 4").otherwise(F.col("html")))
    got = fixity.audit(pages, other).collect()
    assert Counter((r.page_id, r.status) for r in got if r.page_id is not None) == Counter({(p, {-1: "corrupt", 40000: "missing"}.get(p, "ok")): 1 for p in ids if p is not None})
    assert {r.segment for r in got if r.page_id is None}.isdisjoint({r.segment for r in got if r.page_id is not None})
    assert {r.page_id: r.segment for r in got if r.page_id is not None} == {p: p // 1024 for p in ids if p is not None}
    assert sum(r.status == "missing" for r in got) == 2 and len(got) == len(ids)
    steps.clear()
    assert Counter(r.status for r in fixity.audit(pages.where("page_id is null"), other.where("page_id is not null")).collect()) == {"missing": 2, "extra": 7}


def test_ibans_beside_capitals():
    for iban in ("BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00", "BE68539007547034"):
        for before in ("", "IBAN ", "XY99 ", "to XY99 CDEF 1234 "):
            for after in ("", " BIC", " CALL", " NOW PAY THIS", " 1234", " now", ". X"):
                assert [(s, e) for s, e, k in pii.spans(before + iban + after) if k == 4] == [(len(before), len(before) + len(iban))], (before, iban, after)
    assert [k for *_, k in pii.spans("BE68 5390 0754 7034 ES91 2100 0418 4502 0005 1332")] == [4, 4]
    assert pii.redact("BE68 5390 0754 7034 BIC") == "<IBAN> BIC"


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "p3 p4 p5 p6 p7 p8 p9 p10 p11 p12 p13 p14 p15"), (2, "a b c d e"), (3, "absent words that are not in there at all"), (4, None), (5, "few words"), (6, "p3 p4 p5 p6 p7 p8 p9 p10 qq p12 p13 p14 p15 p16")],
                                  "item_id long, text string")
    got = decontaminate.matches(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.shared) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (6, 1, 9), (7, 1, 9), (12, 1, 9)]
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 6 and clean.where("k1 <> 7").count() == 0
    assert decontaminate.matches(none, items).count() == 0 and decontaminate.matches(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    assert normal(df.columns, df.collect()) == normal([d[0] for d in cur.description], cur.fetchall())


def test_pipeline(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = d.columns, {r.doc_id for r in d.select("doc_id").collect()}
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "jaccard_join", "benchmark_decontamination", "pii", "best_fit_packing"]
    for n, stage in corpus_pipeline.STAGES[:-1]:
        d = corpus_pipeline.cut(stage(spark, d, SF))
        assert d.columns == columns
        now = {r.doc_id for r in d.select("doc_id").collect()}
        assert now <= ids and len(now) > 0.5 * len(ids)
        ids = now
        if n == "jaccard_join":
            rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
            assert max(linked(rows)[0]) == 0
        if n == "benchmark_decontamination":
            assert decontaminate.matches(d, benchmark).count() == 0
    assert pii.find(d).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    check_packing(corpus_pipeline.STAGES[-1][1](spark, d, SF).collect(), 4096)


def test_hard_negatives_match_duckdb_with_their_table(spark):
    """The SQL of op11 reads ``embeddings``, a table that ``test_queries_match_duckdb`` does not make known."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    df = queries.QUERIES["op11_hard_negatives"](spark, SF)
    cur = con.execute(queries.ORACLES["op11_hard_negatives"])
    assert normal(df.columns, df.collect()) == normal([d[0] for d in cur.description], cur.fetchall())
