"""The corpus operators against brute force on small tables with nulls, empty and long texts, repeated rows and odd columns."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha1, sha256
from html import unescape

import numpy as np
import pytest
from conftest import DATA

from vigilake import llm
from vigilake.llm import best_fit_packing, decontaminate, html_extract, jaccard_join, line_dedup, media_columns, quality_lm, suffix_dedup, url_filter, warc
from vigilake.llm.common import save

LONG = "many words stand here " * 3000
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
TEXTS = [
    (1, BASE + "\nboiler plate line\nown line one", "a", "en"), (2, BASE + " twentyone\nboiler plate line", "b", "en"), (3, BASE.upper() + "\nboiler plate line", "c", "en"), (4, None, "a", "en"), (5, "", "b", None), (6, " \n\t ", "c", "de"), (7, "short", None, "de"), (7, "short", None, "de"), (8, LONG, "d", "en"), (9, LONG, "e", "en"),
    (10, "Ünïcödé wörds ßtraße here\r\n boiler plate line \x0b", "d", "de"), (None, BASE, "f", None), (11, "a b c d", "f", "en"), (12, "a b c d", "g", "en"), (13, "boiler plate line", "h", "en"), (14, "boiler plate line\nx\nboiler plate line\nboiler plate line\ny", "i", "en"),
]
SCHEMA = "doc_id long, text string, source string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(TEXTS, SCHEMA)
    # names that the operators use themselves
    return df.withColumns({"n": F.lit(1), "token": F.lit("t"), "items": F.array(F.lit(1)), "kept": F.lit("k"), "k1": F.lit(1), "length": F.lit(2), "__n": F.lit(3)})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_against_sql(name, same_as_sql):
    same_as_sql(llm.QUERIES[name], llm.ORACLE_SQL[name])


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", x)[1]) for x in llm.QUERIES) == list(range(1, 14))


# line dedup


def cut_lines(texts, sites):
    edges = " \t\r\x0b\x0c"
    seen = defaultdict(set)
    for _, t, s, _ in texts:
        for x in (t or "").split("\n") if t is not None else []:
            if x.strip(edges) and s is not None:
                seen[x.strip(edges)].add(s)
    common = {x for x, s in seen.items() if len(s) >= sites}
    out = []
    for i, t, _, _ in texts:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        parts = t.split("\n")
        hit = [x.strip(edges) in common for x in parts]
        kept = "\n".join(x for x, h in zip(parts, hit) if not h)
        if any(hit) and not kept.strip(edges + "\n"):
            ids = sorted({j for j, other, _, _ in texts if other == t and j is not None})
            kept = t if len(ids) > 1 and i == ids[0] else ""
        out.append((i, kept, len(parts), sum(hit) if kept != t else 0))
    return out


@pytest.mark.parametrize(("held", "few"), [(line_dedup.HELD_KEYS, 9), (0, 0)])
def test_line_dedup(spark, docs, nothing, held, few):
    # three lines that are all of 30 documents, in copies of two kinds and one by itself, and part of another
    kinds = ["menu\ncookies\nfooter", "footer\n\ncookies", "cookies\nmenu"]
    more = [(100 + i, kinds[i % 2 if i else 2], f"m{i}", "en") for i in range(30)] + [(200, "menu\ncookies\nown\nfooter", "m0", "en"), (None, kinds[0], "m1", "en"), (101, kinds[1], "m1", "en")]
    df = docs.unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True)
    out = line_dedup.dedup_lines(df, 4, held, few)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = [(r.doc_id, r.text, r["__lines"], r["__removed"]) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, cut_lines([*TEXTS, *more], 4)))
    assert sum(t == "" for i, t, *_ in got if i and i >= 100) == 28 and (200, "own", 4, 3) in got
    assert rows(line_dedup.dedup_lines(nothing, 4, held, few)) == []


def test_line_dedup_near_threshold_is_exact(spark):
    texts = [(i, f"line {i % 3}\nshared", f"s{i % (9 + i % 3)}", "en") for i in range(600)]
    got = {bytes(r.line_key) for r in line_dedup.boilerplate_lines(spark.createDataFrame(texts, SCHEMA), 10).collect()}
    sites = defaultdict(set)
    for _, t, s, _ in texts:
        for x in t.split("\n"):
            sites[x].add(s)
    import hashlib

    assert got == {hashlib.md5(x.encode()).digest() for x, s in sites.items() if len(s) >= 10}


# decontamination

ITEMS = [(1, "three four five six seven eight nine ten eleven twelve thirteen"), (2, "A B, C"), (3, None), (4, "  ...  "), (5, "three four five six seven eight nine ten eleven twelve"), (None, "one two three"), (6, "wörds")]


def scan(texts, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(n, len(w))
        if i is not None and m:
            for k in range(len(w) - m + 1):
                grams[tuple(w[k : k + m])].add(i)
    out = []
    for d, t, *_ in texts:
        w, hit, found = words(t), set(), set()
        for m in {len(g) for g in grams}:
            for k in range(len(w) - m + 1):
                if ids := grams.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= ids
        out.append((d, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("most", [decontaminate.HELD_WINDOWS, 0])
def test_contamination(spark, docs, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [(r[0], r[1], r[2], list(r[3])) for r in rows(decontaminate.contamination(docs, items, most=most))]
    assert sorted(map(repr, got)) == sorted(map(repr, scan(TEXTS, ITEMS)))


def test_decontaminate_cuts(spark, docs, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.decontaminate(docs, items)
    assert out.columns == docs.columns
    left = rows(out.select("doc_id", "text", "source", "lang"))
    assert all(hit == 0 for _, _, hit, _ in scan(left, ITEMS))
    clean = {d for d, _, hit, _ in scan(TEXTS, ITEMS) if not hit}
    assert clean <= {r[0] for r in left}
    assert {r[0]: r[1] for r in left if r[0] in clean} == {d: t for d, t, *_ in TEXTS if d in clean}
    assert rows(decontaminate.contamination(nothing, items)) == []
    assert all(r[2] == 0 for r in rows(decontaminate.contamination(docs, items.limit(0))))


# WARC


@pytest.mark.parametrize("chunk", [40, 700, warc.CHUNK])
def test_warc_round_trip(spark, chunk):
    big, other = "x" * 5000, "é" * 600
    pages = [(1, "http://a/", big), (2, "http://b/\r\n", big), (3, None, big), (3, "http://c/", big), (4, "u", other), (5, "u", other), (6, "u", None), (7, "u", ""), (8, "u", "small"), (9, "u", "small"), (None, "u", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    archive = warc.to_archive(df, chunk)
    assert archive.selectExpr("max(octet_length(data))").first()[0] <= chunk
    got = sorted((repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in warc.read_archive(archive).collect()))
    want = []
    for p, _, h in pages:
        raw = (h or "").encode()
        last = max(q for q, _, x in pages if q is not None and (x or "") == (h or ""))
        again = len(raw) >= 1000 and p is not None and p < last
        want.append(repr((p, len(raw), sha1(raw).hexdigest(), "revisit" if again else "response", last if again else None)))
    assert got == sorted(want)
    assert all(r.intact for r in warc.read_archive(archive).collect())


def test_warc_shows_damage(spark):
    from pyspark.sql import functions as F

    archive = warc.to_archive(spark.createDataFrame([(1, "u", "y" * 3000)], "page_id long, url string, html string"), 512)
    bad = archive.withColumn("data", F.when(F.col("chunk_no") == 3, F.encode(F.regexp_replace(F.decode("data", "UTF-8"), "^y", "z"), "UTF-8")).otherwise(F.col("data")))
    assert [r.intact for r in warc.read_archive(bad).collect()] == [False]
    assert warc.read_archive(warc.to_archive(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_warc_revisits_need_their_response_and_chunks_are_a_file(spark):
    import base64

    from pyspark.sql import functions as F

    big = "payload é " * 20_000
    pages = spark.createDataFrame([(1, "http://a/", big), (2, "http://b/", big), (3, "http://c/", "s"), (3, "http://c/", "s")], "page_id long, url string, html string").withColumns({"digest": F.lit("x"), "record": F.lit(1), "last": F.lit(2)})
    archive = warc.to_archive(pages, 1000)
    assert {r.page_id: (r.record_type, r.intact) for r in warc.read_archive(archive).collect()} == {1: ("revisit", True), 2: ("response", True), 3: ("response", True)}
    rows = archive.orderBy("record", "chunk_no").collect()
    of = {r.record: b"".join(x.data for x in rows if x.record == r.record) for r in rows}
    gone = [k for k, x in of.items() if b"<urn:page:2>" in x.split(b"\r\n\r\n")[0] and b"WARC-Type: response" in x]
    assert {r.page_id: r.intact for r in warc.read_archive(archive.where(~F.col("record").isin(gone))).collect()} == {1: False, 3: True}
    # read as a WARC file by the lengths in its headers
    data, found = b"".join(of.values()), []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        block, data = data[: int(fields["Content-Length"])], data[int(fields["Content-Length"]) :]
        assert lines[0] == "WARC/1.1" and data[:4] == b"\r\n\r\n"
        data = data[4:]
        payload = block.split(b"\r\n\r\n", 1)[1]
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(sha1(payload).digest()).decode()
        found.append((fields["WARC-Record-ID"], fields["WARC-Type"], len(payload)))
    assert sorted(found) == [("<urn:page:1>", "revisit", 0), ("<urn:page:2>", "response", len(big.encode())), ("<urn:page:3>", "response", 1), ("<urn:page:3>", "response", 1)]


# packing


def test_word_tokens_equal_the_tokenizer():
    t = best_fit_packing.WordTokens(best_fit_packing.TOKENIZER)
    texts = [x[1] or "" for x in TEXTS] + ["don't we'll 'tis 12345 \x1c a\x85b ΣΑΣ İ ǅ", "foo<|endoftext|>bar <|startoftext|>", "é ́x  y ª²", "日本語 😀x!!'s", "THE!! a%%%b -'re- \x01 z"]
    for x, e in zip(texts, t.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(t.ids([x])[0], "<u4").tolist() == e.ids


def check_packing(got, texts, size):
    t = best_fit_packing.WordTokens(best_fit_packing.TOKENIZER)
    want = Counter()
    for (d, *_), ids in zip(texts, t.ids([x[1] or "" for x in texts])):
        ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(1)).astype("<u4")
        for k, at in enumerate(range(0, len(ids), size)):
            want[(d, k, at, len(ids[at : at + size]), zlib.crc32(ids[at : at + size].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), -(-sum(r.length for r in got) // size)


def test_packing(spark, docs, nothing):
    used, least = check_packing(best_fit_packing.pack(docs, 64).collect(), TEXTS, 64)
    assert used <= 1.1 * least + 1
    assert best_fit_packing.pack(nothing).collect() == []
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    used, least = check_packing(best_fit_packing.pack(df).collect(), [(r.doc_id, r.text) for r in df.collect()], 4096)
    assert used <= least + 1


@pytest.mark.parametrize("histogram", [{}, {1: 1}, {4096: 3}, {2049: 5, 2047: 5}, {700: 11, 3: 9, 4000: 2}, dict.fromkeys(range(1, 4097), 3)])
def test_plan_places_every_piece_once(histogram):
    seen = Counter()
    for length, first, pieces, *_ in best_fit_packing.plan(histogram):
        assert seen[length] == first
        seen[length] += pieces
    assert seen == Counter(histogram)


# n-gram Jaccard join


def components(texts, n=5, share=75):
    sets = {}
    for k, (_, t, *_) in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if None in (texts[i][0], texts[j][0]):
                continue
            if i < j and a and b and 100 * len(a & b) >= share * len(a | b) or texts[i][0] is not None and texts[i][0] == texts[j][0]:
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    low = {}
    for k, (d, *_) in enumerate(texts):
        if d is not None:
            low[find(k)] = min(low.get(find(k), d), d)
    return [(d, len(sets[k]), low[find(k)] if d is not None else None) for k, (d, *_) in enumerate(texts)]


def test_jaccard_join(spark, docs, nothing):
    got = {r[0]: r[1:] for r in rows(jaccard_join.similarity_components(docs)) if r[0] is not None}
    assert got == {r[0]: r[1:] for r in components(TEXTS) if r[0] is not None}
    assert len(rows(jaccard_join.similarity_components(docs))) == len(TEXTS)
    assert rows(jaccard_join.similarity_components(nothing)) == []
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns


def test_jaccard_join_chain_of_near_copies(spark):
    rng = np.random.default_rng(5)
    texts, words = [], [f"w{i}" for i in range(120)]
    for k in range(160):
        if k % 40 == 0:
            words = [f"v{rng.integers(1000)}" for _ in range(60 + k)]
        words = words.copy()
        words[rng.integers(len(words))] = f"e{k}"
        if k % 7 == 0:
            words = words[1:]
        texts.append((k, " ".join(words), "s", "en"))
    got = sorted(rows(jaccard_join.similarity_components(spark.createDataFrame(texts, SCHEMA))))
    assert got == sorted(components(texts))


# media columns


def test_media_columns(spark, docs, nothing):
    store = media_columns.stored(docs)
    assert store.count() == store.select("digest").distinct().count() == len({t or "" for _, t, *_ in TEXTS})
    found = store.mapInArrow(media_columns._features, media_columns.FEATURES)
    sequences = docs.select("doc_id", "text").mapInArrow(media_columns._interleave_documents, f"doc_id long, parts {media_columns.PARTS}")
    got = media_columns.resolve(sequences, found).collect()
    assert len(got) == len(TEXTS)
    by = {r.doc_id: r for r in got}
    for d, t, *_ in TEXTS:
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        media = media_columns.to_media(raw)
        r = by[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.digest) == (len(media), sha256(media).hexdigest())
        assert media_columns.from_media(media)[0].tobytes() == padded
        lines = [x for x in (t or "").split("\n") if x.strip()]
        assert (r.position, r.n_parts, r.caption) == (len(lines) // 2, len(lines) + 1, f"payload of document {d}")
    for r in sequences.collect():  # text and media in the order of the page
        lines = [" ".join(x.split()) for x in next((t for d, t, *_ in TEXTS if d == r.doc_id), None).split("\n") if x.strip()] if r.doc_id not in (4, None) else None
        assert lines is None or [p.text for p in r.parts if p.kind == "text"] == lines
        assert [p.position for p in r.parts] == list(range(len(r.parts)))
    assert media_columns.stored(nothing).count() == 0


def test_sequences_of_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").selectExpr("page_id AS doc_id", "html")
    texts = {r.doc_id: [p.text for p in r.parts] for r in media_columns.interleave(pages).collect()}
    for p in pages.collect():
        title = " ".join(unescape(re.search("<h1>(.*?)</h1>", p.html)[1]).split())
        assert title in texts[p.doc_id] and "track(" not in "".join(texts[p.doc_id])


def test_interleaved_parts(spark):
    html = '<p>one <b>two</b></p><figure><img src="sha256:aa" alt="x"><figcaption>cap <i>tion</i></figcaption></figure>three<figure><figcaption>first</figcaption><img src="u"></figure><script>no</script><img src="v" alt="alt">'
    parts = media_columns.parts_of(html)
    assert [(p["kind"], p["text"] or p["ref"], p["caption"]) for p in parts] == [("text", "one two", None), ("media", "sha256:aa", "cap tion"), ("text", "three", None), ("media", "u", "first"), ("media", "v", "alt")]
    assert [p["position"] for p in parts] == list(range(5))
    assert media_columns.parts_of(None) == []
    pages = spark.createDataFrame([(1, html), (2, None)], "doc_id long, html string")
    out = media_columns.resolve(media_columns.interleave(pages), spark.createDataFrame([("aa" * 32, 1)], "digest string, n_bytes long")).collect()
    assert len(out) == 3 and all(r.n_bytes is None for r in out)


# URL filter


def test_url_aliases(spark):
    link = '<html><head><link rel="canonical" href="{}"></head>'
    pages = [
        (1, "http://a.org/x#f", link.format("http://b.org/y")), (2, "http://b.org/y", link.format("http://example.com/en/1")), (3, "http://c.org/", "<meta http-equiv=refresh content='0; url=/en/z'>"), (4, "http://www.example.com/en/q", None), (5, "HTTP://Sub.Example.COM/en/?a", ""), (6, None, "x"), (7, "no scheme", "x"),
        (8, "http://d.net/es/", link.format("http://d.org/")), (9, "http://d.org/", "<link href=http://e.com/ rel=canonical>"), (10, "http://x.net?/es/", None), (11, "http://b.org/y", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    for inline in (64, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules, inline=inline).collect()}
        assert got == {
            1: ("a.org", "/x", None, "block"), 2: ("b.org", "/y", None, "block"), 3: ("c.org", "/", None, "allow"), 4: ("www.example.com", "/en/q", "www.example.com/en/", "allow"), 5: ("sub.example.com", "/en/", "example.com/en/", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
            8: ("d.net", "/es/", "net/es/", "block"), 9: ("d.org", "/", None, "allow"), 10: ("x.net", "", None, "allow"), 11: ("b.org", "/y", None, "block"),
        }
    more = spark.createDataFrame([("http://c.org/", "http://example.com/en/"), (None, "x")], "source string, target string")
    assert {r.page_id: r.verdict for r in url_filter.judge(df, rules, more).collect()}[3] == "block"
    assert url_filter.judge(df.limit(0), rules).collect() == []


def aliases(pages, rules):
    """(page_id, verdict) by the standard library's parser and url functions and a walk over the links."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin, urlsplit

    def node(url):
        u = urlsplit(urljoin(url, "#")) if url and "://" in url else None
        return u and u._replace(scheme=u.scheme.lower(), netloc=u.netloc.lower(), fragment="").geturl()

    class Links(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = []

        def handle_starttag(self, tag, attrs):
            given = {k: v or "" for k, v in attrs}
            if tag == "link" and "canonical" in given.get("rel", "").lower().split():
                self.found.append(given.get("href", "").strip())
            if tag == "meta" and given.get("http-equiv", "").lower() == "refresh" and (m := re.search(r"(?i)url\s*=\s*[\"']?([^\"']*)", given.get("content", ""))):
                self.found.append(m[1].strip())

        handle_startendtag = handle_starttag

    near = defaultdict(set)
    for _, url, html in pages:
        if url and "://" in url:
            parser = Links()
            parser.feed(html or "")
            for t in parser.found:
                if t and not t.startswith("#") and "://" in (full := urljoin(url, t)):
                    near[node(url)].add(node(full))
                    near[node(full)].add(node(url))

    def own(url):
        u = urlsplit(url)
        fits = [(len(h + p), v) for h, p, v in rules if (u.netloc.lower() == h or u.netloc.lower().endswith("." + h)) and u.path.startswith(p)]
        return max(fits)[1] if fits else None

    out = []
    for i, url, _ in pages:
        verdict = own(url) if url and "://" in url else "allow"
        if verdict is None:
            seen, todo = {node(url)}, [node(url)]
            while todo:
                for x in near[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            kinds = {own(x) for x in seen}
            verdict = "block" if "block" in kinds and "allow" not in kinds else "allow"
        out.append((i, verdict))
    return out


def test_url_links_of_all_forms(spark):
    forms = [
        '<link rel="canonical" href="http://bad.org/p?a=1&amp;q=2">', "<link rel='alternate  CANONICAL' href='//bad.org/k'>", '<link href="../up" rel=canonical>', '<link data-href="http://bad.org/p" rel="canonical" href="http://fine.org/">', '<!-- <link rel="canonical" href="http://bad.org/p"> -->',
        '<script>var x = \'<link rel="canonical" href="http://bad.org/p">\';</script>', '<link rel="canonical" href="http://fine.org/1"><link rel="canonical" href="HTTP://BAD.org/./p/../k#top">', '<meta content="5; URL=\'http://bad.org/k\'" http-equiv="Refresh">', '<link rel="canonical" title="a > b" href="page.html"/>',
        '<link rel="canonical" href="?id=2">', '<link rel="canonical" href="mailto:a@bad.org">', '<link rel="canonical" href="#x">', '<link rel="canonical" href="">', '<link rel="stylesheet" href="http://bad.org/p">', '<link rel="canonical" href=" http://bad.org/k\n">', None,
    ]
    pages = [(k, f"http://s{k}.org/dir/x.html", f) for k, f in enumerate(forms)] + [(20, "http://bad.org/p?a=1&q=2", None), (21, "http://s2.org/up", '<link rel="canonical" href="http://bad.org/k">'), (22, "http://s8.org/dir/page.html", "<meta http-equiv=refresh content='0;url=//BAD.org/k'>"), (23, "http://s9.org/dir/x.html?id=2", '<link rel="canonical" href="/../k2/.">')]
    pages += [(24, "http://s9.org/k2/", '<link rel="canonical" href="http://bad.org/k">'), (25, "http://nice.org/a", '<link rel="canonical" href="http://bad.org/p2">'), (26, "http://w.org/", '<link rel="canonical" href="http://nice.org/a">'), (26, "http://w.org/", None), (27, "http://long.org/", "x" * 300_000 + '<link rel="canonical" href="http://bad.org/k">')]
    rules = [("bad.org", "/", "block"), ("nice.org", "/", "allow")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit(1), "rule": F.lit(2), "node": F.lit(3)})
    got = [(r.page_id, r.verdict) for r in url_filter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()]
    assert sorted(got) == sorted(aliases(pages, rules))
    assert {i for i, v in got if v == "block"} == {0, 1, 2, 6, 7, 8, 9, 14, 20, 21, 22, 23, 24, 27}


# HTML extraction


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<p>a<p>b &amp; c", "a\nb & c"), ("<article>x <b>y</b>z<!-- cut", "x yz"), ("<article><p>q</p><script>var a='<p>no</p>';", "q"), ("<article>a &lt;b&gt; c</article><p class='x", "a <b> c"),
        ("<nav>menu</nav><article><h1>T</h1><p class=ad>AD<p>real<ul><li>one<li class=promo>no<li>two</ul></article><footer>f</footer>", "T\nreal\none\ntwo"), ("<article><p>x</p></article><p>a much longer line of text outside of it all</p>", "x"),
        ("<header>H</header><div class='cookie-notice'>We use</div><div id=content><h1>T</h1><p>Long text of an article that goes on and on for a while.</p><p>Short.</p></div><div class=sidebar>s s</div><form>f</form><div class=comments><p>I agree with all of that, it is so true indeed.</p></div>", "T\nLong text of an article that goes on and on for a while.\nShort."),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


PARAGRAPH = "A paragraph of the article that goes on for quite a while, as such paragraphs do. "


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # nothing but <div>: what is dense decides
        (f"<div><a href=/>Home</a> <a href=/a>About</a></div><div><h1>T</h1><p>{PARAGRAPH * 3}</p><p>Yes.</p></div><div>Legal</div>", f"T\n{(PARAGRAPH * 3).strip()}\nYes."), (f"<div><div><p>{PARAGRAPH * 9}</p></div><div><p>{PARAGRAPH * 3}</p></div></div><div>x</div>", f"{(PARAGRAPH * 9).strip()}\n{(PARAGRAPH * 3).strip()}"),
        (f"<div><h1>T</h1><div><p>{PARAGRAPH * 3}</p></div></div><div><p>Elsewhere</p></div>", f"T\n{(PARAGRAPH * 3).strip()}"), (f"<article><h1>T</h1><p>lead</p><div><p>{PARAGRAPH * 3}</p></div></article>", f"T\nlead\n{(PARAGRAPH * 3).strip()}"),
        # names that only look like boilerplate, and a short box that is
        (f"<article><div class='social-science'><p>{PARAGRAPH * 2}</p></div><p class=form>{PARAGRAPH * 2}</p><div class=promo-box>Buy</div></article>", f"{(PARAGRAPH * 2).strip()}\n{(PARAGRAPH * 2).strip()}"),
        (f"<main><p>{PARAGRAPH * 2}</p><div><ul><li><a href=/1>One thing</a></li><li><a href=/2>Another</a></li></ul></div><p>End.</p><div class=comments><p>{PARAGRAPH}</p></div></main>", f"{(PARAGRAPH * 2).strip()}\nEnd."),
        (f"<table><tr><td>{PARAGRAPH}</td><td>cell</td></tr></table>", f"{PARAGRAPH.strip()}\ncell"), ("x" * 200_000 + "<p>" + "y " * 100_000, "x" * 200_000 + "\n" + ("y " * 100_000).strip()),
    ],
)
def test_main_text_by_density(html, text):
    assert html_extract.main_text(html) == text


def test_density_decides_where_nothing_is_marked(spark, monkeypatch):
    """With every container a bare <div>, most pages come out as before, and fewer do if every line counts as dense."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    want = [html_extract.main_text(x) for x in pages]
    bare = [re.sub(r"<(/?)(?:nav|footer|article|div)\b[^>]*>", r"<\1div>", x) for x in pages]
    right = sum(html_extract.main_text(x) == w for x, w in zip(bare, want))
    monkeypatch.setattr(html_extract, "dense_lines", lambda lines: np.ones(len(lines), bool))
    assert right >= 0.7 * len(pages) and sum(html_extract.main_text(x) == w for x, w in zip(bare, want)) < right


def test_extract_odd_rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)], "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit(2), "lines": F.lit(3)})
    assert sorted(map(repr, rows(html_extract.extract_text(df)))) == sorted(map(repr, [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]))
    assert rows(html_extract.extract_text(df.limit(0))) == []


def test_extract_pages(spark):
    import html as H

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_text(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(x for x in blocks if x)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


# quality classifier


def kneser_ney(texts, order=5):
    counts = [None, *(Counter() for _ in range(order))]
    for t in texts:
        raw = b"\n" * (order - 1) + t.encode()
        counts[order].update(raw[i : i + order] for i in range(len(raw) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts, totals, gammas = [None], [None], [None]
    for n in range(1, order + 1):
        of = Counter(min(c, 5) for c in counts[n].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.5
        d = [0, *(max(0, i - (i + 1) * y * of[i + 1] / of[i]) if i < 4 and of[i] else i * 0.5 for i in (1, 2, 3))]
        total, gamma = Counter(), Counter()
        for g, c in counts[n].items():
            total[g[:-1]] += c
            gamma[g[:-1]] += d[min(c, 3)]
        discounts.append(d), totals.append(total), gammas.append(gamma)

    def p(g):
        out = 1 / 256
        for n in range(1, order + 1):
            s = g[order - n :]
            if total := totals[n][s[:-1]]:
                c = counts[n][s]
                out = (c - discounts[n][min(c, 3)] if c else 0) / total + gammas[n][s[:-1]] / total * out
        return out

    def perplexity(t):
        raw = b"\n" * (order - 1) + t.encode()
        return float(np.exp(-np.mean([np.log(p(raw[i : i + order])) for i in range(len(raw) - order + 1)])))

    return perplexity


@pytest.mark.parametrize("held", [quality_lm.HELD_GRAMS, 10])
def test_quality_model(spark, held):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("aeioustnr"), rng.integers(1, 6)))
    texts = [(i, " ".join(word() for _ in range(12)), "s", "xy") for i in range(160)] + [(500 + i, "#$%@! " * 9, "s", "xy") for i in range(3)] + [(600, None, "s", "xy"), (601, "", "s", None), (602, "other language", "s", "zz"), (None, "aeiou", "s", "xy")]
    df = spark.createDataFrame(texts, SCHEMA).withColumn("gram", F.lit(1))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(3, 0, 0), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_lm.judged(df, labels, held=held).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(quality_lm.HELD_OUT))).collect()
    good = [r for r in out if r.doc_id is not None and r.doc_id < 150 and r.doc_id not in (3,)]
    model = kneser_ney([r.text for r in good if r.part > 0])
    for r in out:
        if r.text and r.lang == "xy":
            assert r["__perplexity"] == pytest.approx(model(r.text), rel=1e-6)
    keep = {r.doc_id: r["__keep"] for r in out}
    assert not any(keep[500 + i] for i in range(3)) and not keep[600] and not keep[601] and keep[602]
    assert sum(keep[i] for i in range(150)) >= 147
    assert quality_lm.keep_good(df, labels.limit(0)).columns == df.columns
    assert quality_lm.judged(df.limit(0), labels).collect() == []


def decisions(texts, labels, part):
    """(keep, threshold by language) of every text by models made with kneser_ney; part: doc_id -> its fold."""
    bad = {i for i, q, t in labels if q != 1 or t}
    good = {i for i, *_ in labels} - bad
    trusted = [(i, t, x or "") for i, t, _, x in texts if i in good]

    def repeated(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        pairs = list(zip(w, w[1:]))
        return round(1 - len(set(pairs)) / len(pairs), 4) if pairs else 0.0

    models = {x: kneser_ney([t or "" for i, t, y in trusted if y == x and part[i] > 0]) for x in {x for *_, x in trusted}}
    held = {x: [t for i, t, y in trusted if y == x and t and part[i] == 0] for x in models}
    scores = {x: np.round([models[x](t) for t in v], 4) for x, v in held.items()}
    shares = [repeated(t) for v in held.values() for t in v]
    spread = np.quantile(np.concatenate([np.round(v / np.median(v), 4) for v in scores.values() if len(v)]), quality_lm.QUANTILE)
    bound = {}
    for x, v in scores.items():
        weight = len(v) / (len(v) + quality_lm.DRAWN)
        bound[x] = round(float(weight * np.quantile(v, quality_lm.QUANTILE) + (1 - weight) * np.median(v) * spread if len(v) else np.quantile(np.concatenate(list(scores.values())), quality_lm.QUANTILE)), 4)
    most = max(np.quantile(shares, quality_lm.QUANTILE), quality_lm.REPEATED)
    return {(i, t): bool(t) and ((x or "") not in bound or round(models[x or ""](t), 4) <= bound[x or ""]) and repeated(t) <= most for i, t, _, x in texts}, bound


def test_quality_decisions_by_brute_force(spark):
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{DATA}/documents.parquet").where("lang in ('de', 'fr')").select("doc_id", F.left("text", F.lit(3000)).alias("text"), "source", "lang")
    df = save(df.unionByName(df.limit(2)), "texts")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality", "toxic")
    part = {r.doc_id: r.part for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(quality_lm.HELD_OUT)).alias("part")).collect()}
    keep, bound = decisions(rows(df), rows(labels), part)
    got = quality_lm.judged(df, labels).collect()
    assert len(got) == len(part) + 2 and {r.lang: r["__threshold"] for r in got} == pytest.approx(bound, abs=2e-4)
    near = lambda r: abs(r["__perplexity"] - bound[r.lang]) < 1e-3
    assert [(r.doc_id, r["__keep"], r["__perplexity"], bound[r.lang], r.text[:40]) for r in got if r["__keep"] != keep[r.doc_id, r.text] and not near(r)] == []
    assert {True, False} <= {r["__keep"] for r in got}


def test_quality_on_held_out_labels(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_lm.judged(df, labels).join(labels, "doc_id").where("toxic = 0").groupBy("quality").agg({"__keep": "count"}).collect()
    kept = {r.quality: r for r in quality_lm.judged(df, labels).join(labels, "doc_id").where("toxic = 0").selectExpr("quality", "cast(__keep as int) k").groupBy("quality").avg("k").collect()}
    assert got and kept[1][1] >= 0.95 and kept[0][1] <= 0.35


def test_quality_of_few_trusted_documents_and_of_repetition(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("aeioustnr"), rng.integers(1, 6)))
    prose = lambda: " ".join(word() for _ in range(40))
    texts = [(i, prose(), "s", "xy" if i < 300 else "small") for i in range(312)]
    texts += [(1000 + i, "#$%@! QXZ " * 9, "s", "small") for i in range(3)] + [(2000 + i, (word() + " ") * 60, "s", x) for i in range(3) for x in ("xy", "small")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(312)], "doc_id long, quality int, toxic int")
    keep = {r.doc_id: r["__keep"] for r in quality_lm.judged(spark.createDataFrame(texts, SCHEMA), labels).collect()}
    assert not any(keep[i] for i in keep if i >= 1000)
    assert sum(keep[i] for i in range(300)) >= 290 and sum(keep[i] for i in range(300, 312)) >= 10


def test_quality_rejects_in_every_language_with_trusted_text(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_lm.judged(df, labels).join(labels, "doc_id").where("quality = 0").collect()
    assert sum(r["__keep"] for r in got) <= 2 and all(r["__threshold"] is not None for r in got)


# suffix arrays


def cut_bytes(texts, span):
    seen = Counter()
    raws = [(d, (t or "").encode()) for d, t, *_ in texts]
    for _, t in raws:
        seen.update(t[i : i + span] for i in range(len(t) - span + 1))
    out = []
    for d, t in raws:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = True
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1)), sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot_rows", [suffix_dedup.HOT_ROWS, 2])
def test_suffix_dedup(spark, docs, nothing, hot_rows):
    small = [r for r in TEXTS if r[0] not in (8, 9)]
    rng = np.random.default_rng(7)
    alphabet = list("ab cé")
    block = "".join(rng.choice(alphabet, 300))
    for k in range(12):
        a, b = sorted(rng.integers(0, 300, 2))
        small.append((100 + k, "".join(rng.choice(alphabet, 40)) + block[a:b] + "ab" * int(rng.integers(0, 60)), "s", "en"))
    got = [tuple(r)[:5] for r in suffix_dedup.cut_repeats(spark.createDataFrame(small, SCHEMA), 48, hot_rows=hot_rows).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, cut_bytes(small, 48)))
    if hot_rows > 2:
        assert suffix_dedup.cut_repeats(nothing).collect() == []
        assert {r.doc_id: r.n_removed for r in suffix_dedup.cut_repeats(docs).collect()}[8] == len(LONG)


def test_suffix_dedup_of_repeated_rows(spark):
    word = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    texts = [(1, word(0, 40), "s", "en")] * 60 + [(None, word(0, 40), "s", "en")] * 3 + [(2, word(10, 60), "s", "en"), (2, word(100, 140), "s", "en"), (3, word(100, 130), "s", "en"), (None, word(200, 240), "s", "en"), (None, None, None, None)]
    got = [tuple(r)[:5] for r in suffix_dedup.cut_repeats(spark.createDataFrame(texts, SCHEMA), 48).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, cut_bytes(texts, 48)))


def test_suffix_array_kernels():
    rng = np.random.default_rng(1)
    for trial in range(60):
        span = int(rng.integers(9, 40))
        alphabet = [b"a", b"ab", b"abcdefgh"][trial % 3]
        base = bytes(rng.choice(list(alphabet), 120).tolist())
        contexts = {base[a : a + span + int(rng.integers(0, 40))] for a in rng.integers(0, 120 - span, 8)}
        contexts = [c for c in contexts if len(c) >= span]
        at = defaultdict(list)
        for i, c in enumerate(contexts):
            for j in range(len(c) - span + 1):
                at[c[j : j + span]].append((i, j))
        want = {x for v in at.values() if len(v) > 1 for x in v} if len(contexts) > 1 else set()
        got = suffix_dedup.repeats_within(contexts, [1] * len(contexts), [0] * len(contexts), span)
        assert {(i, int(j)) for i, m in enumerate(got) for j in np.flatnonzero(m)} == want
        if len(contexts) > 1:
            left, right = contexts[: len(contexts) // 2], contexts[len(contexts) // 2 :]
            strings = [{c[j : j + span] for c in s for j in range(len(c) - span + 1)} for s in (left, right)]
            for s, other, found in zip((left, right), (1, 0), suffix_dedup.repeats_between(left, right, span)):
                assert all(m[j] == (c[j : j + span] in strings[other]) for c, m in zip(s, found) for j in range(len(m)))
