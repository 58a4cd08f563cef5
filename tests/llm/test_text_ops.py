"""Quality, mixing, licenses, exact dedup, pages and URLs."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sigwin.llm import exact_dedup, html_extract, license_scan, mixing, quality, url_filter

from .conftest import TEXTS

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_dedup_is_brute_force(docs, no_docs):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.keep_id, r.group_size, r.kept, r.text_sha256)
                 for r in exact_dedup.dedup_report(docs).collect())
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[hashlib.sha256((t or "").translate(ASCII).encode()).hexdigest()].append(i)
    want = []
    for sha, ids in groups.items():
        keep, left = max((i for i in ids if i is not None), default=None), 1
        for i in ids:
            kept = i == keep and left == 1
            left -= kept
            want.append((i is not None, i or 0, keep, len(ids), kept, sha))
    assert got == sorted(want)
    assert exact_dedup.dedup_report(no_docs).count() == 0
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_dedup_full_filter(docs, monkeypatch):
    want = sorted(map(str, exact_dedup.dedup_report(docs).collect()))
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 0)  # all rows in one block: many more shuffle
    assert sorted(map(str, exact_dedup.dedup_report(docs).collect())) == want


@pytest.mark.parametrize("broadcast", ["", "1"])
def test_exact_dedup_of_a_shuffled_table(spark, broadcast):
    """Rows whose places differ from read to read: each of 500 texts keeps one row; columns clash with all names used."""
    clash = ["_row", "_sha", "sha", "_block", "_bits", "_maybe", "_key", "maybe", "__KEY", "_stays", "_times", "bits"]
    df = spark.range(4000).selectExpr(
        "id AS doc_id", "concat(if(id % 2 = 0, 'Text ', 'tEXT '), id % 500) AS text", *[f"id * 3 AS `{c}`" for c in clash])
    spark.conf.set("sigwin.broadcast.maxBytes", broadcast or str(64 << 20))
    try:
        for docs in (df.repartition(3), df.repartition(7), df.unionByName(df).repartition(5)):
            kept = exact_dedup.deduplicated(docs)
            assert kept.columns == docs.columns
            rows = kept.collect()
            assert sorted(r.doc_id for r in rows) == list(range(3500, 4000))
            assert all(r[c] == 3 * r.doc_id for r in rows for c in clash)
            report = exact_dedup.dedup_report(docs).collect()
            assert len(report) == docs.count() and sum(r.kept for r in report) == 500
            assert {r.group_size for r in report} == {docs.count() // 500}
    finally:
        spark.conf.unset("sigwin.broadcast.maxBytes")


def test_exact_dedup_of_null_ids(spark):
    rows = [(None, "a"), (None, "A"), (3, "b"), (None, "B"), (3, "b"), (4, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in exact_dedup.deduplicated(df).collect()))) in (
        [str(x) for x in sorted([(3, "b"), (4, None), (None, t)], key=str)] for t in ("a", "A"))
    assert sum(r.kept for r in exact_dedup.dedup_report(df).collect()) == 3


def test_mix_leaves_columns_of_its_own_names_alone(spark):
    clash = ["_size", "_source", "_source_size", "_target", "_rate", "_copies", "_copy", "SIZE", "copies"]
    df = spark.range(300).selectExpr("id AS doc_id", "repeat('w ', int(id % 9)) AS text", "concat('s', id % 4) AS source",
                                     *[f"id * 7 AS `{c}`" for c in clash])
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert all(r[c] == 7 * r.doc_id for r in rows for c in clash)
    assert len(rows) == sum(r.copies for r in mixing.mix_report(df).collect())


def test_exact_dedup_plan_is_native(docs):
    plan = exact_dedup.dedup_report(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_targets_are_water_filling(spark):
    sizes = [("b", 10), ("b", 0), ("a", 1000), ("c", 1), (None, 50), ("d", 0)]
    got = {r.source: (r.source_size, r.target) for r in
           mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    total = defaultdict(int)
    for s, n in sizes:
        total[s] += n
    order = sorted(s for s in total if s is not None) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    left, target, all_words = set(order), {}, sum(total.values())
    while True:  # as the contract says it: cap, share the excess again
        rest = all_words - sum(target.values())
        over = [s for s in left if rest * weight[s] / sum(weight[x] for x in left) > 3 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left.remove(s)
    rest = all_words - sum(target.values())
    target |= {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
    assert {s: n for s, (n, _) in got.items()} == total
    for s in order:
        assert got[s][1] == pytest.approx(target[s])


def test_mix(docs, no_docs):
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == len(TEXTS) and sorted(map(str, mixing.mix_report(docs).collect())) == sorted(map(str, rows))
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].size == by_id[4].size == by_id[7].size == 0 and by_id[8].size == 6
    assert mixing.mix_report(no_docs).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)


def test_mix_comes_near_targets(spark):
    """Within five standard deviations of independent draws for each source, and 5 % over all."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rate = F.col("target") / F.col("source_size")
    spread = F.sum((rate - F.floor(rate)) * (1 - rate + F.floor(rate)) * F.col("size") ** 2)
    per = mixing.mix_report(d).join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.max("target").alias("target"), spread.alias("variance")).collect()
    assert all(abs(r.taken - r.target) <= 5 * r.variance ** 0.5 + 1 for r in per)
    assert abs(sum(r.taken for r in per) / sum(r.target for r in per) - 1) < 0.05


def test_licenses(docs, no_docs):
    rows = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect() if r.doc_id not in (9, 10, None)}
    assert (rows[1].n_words, rows[1].n_base, rows[1].first_word, rows[1].last_word) == (9, 3, 1, 6)
    assert rows[1].base_labels == "cc-by,gpl,reserved" and rows[1].labels == rows[2].labels and 0 < rows[1].score <= 1
    for i in (3, 4, 7):
        assert (rows[i].n_words, rows[i].n_base, rows[i].first_word, rows[i].labels, rows[i].score) == (0, 0, None, "", 0)
    assert license_scan.scan_licenses(no_docs).count() == 0


def test_license_rules_and_containment():
    assert len(license_scan.rules()) > 200
    _, base, kept = license_scan.scan("Licensed under the Apache License, Version 2.0 and cc by sa 4.0 -- ACC BY cc byte")
    assert [d[2] for d in kept] == ["apache-2.0", "cc-by-sa-4.0"] and base == [(9, "cc-by")]
    assert license_scan.resolve([(0, 9, 0), (2, 5, 1), (2, 12, 1), (0, 9, 2)], [5, 1, 5]) == [(0, 9, 0), (2, 12, 1)]


def _some_match(pattern, rng):
    """A random string that the pattern matches."""
    def make(items):
        out = ""
        for kind, value in items:
            name = str(kind)
            if name == "LITERAL":
                out += chr(value)
            elif name == "NOT_LITERAL":
                out += rng.choice("qz7")
            elif name == "IN":
                some, first = rng.choice([v for v in value if str(v[0]) != "NEGATE"]), str(value[0][0])
                out += rng.choice("qz7") if first == "NEGATE" else chr(
                    some[1] if str(some[0]) == "LITERAL" else rng.randint(*some[1]))
            elif name == "BRANCH":
                out += make(rng.choice(value[1]))
            elif name == "SUBPATTERN":
                out += make(value[3])
            elif name == "MAX_REPEAT":
                out += "".join(make(value[2]) for _ in range(rng.randint(value[0], min(value[1], value[0] + 3))))
            else:
                raise AssertionError(name)
        return out
    return make(re._parser.parse(pattern))


def test_license_keywords_are_in_all_matches_and_rules_find_them():
    rng = random.Random(3)
    for rule in license_scan.rules():
        for _ in range(12):
            text = " ".join(_some_match(rule.pattern, rng).split())
            if not re.fullmatch(rule.pattern, text):
                continue  # an optional space at the end
            assert rule.keyword in text, rule
            found = license_scan.scan("so " + text.upper() + " it is")[2]
            assert any(s <= 1 and e >= 1 + len(text.split()) for s, e, *_ in found), (rule, text, found)


def test_license_scan_is_brute_force(spark):
    """Every rule run on every text, containment tested pair by pair."""
    rng, made = random.Random(5), []
    for _ in range(60):
        parts = [_some_match(rng.choice(license_scan.rules()).pattern, rng) if rng.random() < 0.7 else "and so, on"
                 for _ in range(rng.randint(1, 9))]
        made.append(rng.choice([" ", " -- ", "\n"]).join(parts))
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rules = [(re.compile(rf"(?<![^ ]){r.pattern}(?![^ ])"), r) for r in license_scan.rules()]
    for text in made + docs + [t for _, t in TEXTS if t is None or len(t) < 1000]:
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
        joined = b" ".join(words).decode()
        found = [(m.start(), m.end(), i) for i, (p, _) in enumerate(rules) for m in p.finditer(joined)]
        kept = []
        for s, e, i in sorted(found, key=lambda d: (-rules[d[2]][1].priority, d[0] - d[1], d[2], d[0])):
            if not any(a <= s and e <= b for a, b, _ in kept):
                kept.append((s, e, i))
        n, base, detections = license_scan.scan(text)
        assert n == len(words)
        assert base == sorted((joined[:s].count(" "), rules[i][1].label) for s, _, i in found if i < 3)
        assert detections == [(joined[:s].count(" "), joined[:e].count(" ") + 1, rules[i][1].label, rules[i][1].strength)
                              for s, e, i in sorted(kept)]


def test_quality_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (10, 1, 0), (50, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality.score_documents(no_docs, labels).count() == 0
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    clash = docs.withColumn("_score", F.lit(5)).withColumn("__SCORE", F.lit("x"))
    good = quality.good_documents(clash, labels)
    assert good.columns == clash.columns and {(r["_score"], r["__SCORE"]) for r in good.collect()} == {(5, "x")}


@pytest.mark.parametrize("at_once", [1, 1 << 20])
def test_word_rows_and_pooling_are_brute_force(monkeypatch, at_once):
    """Words as the pattern finds them in whole texts; sums of neighbours and pooled vectors word by word."""
    monkeypatch.setattr(quality, "AT_ONCE", at_once)
    texts = [t or "" for _, t in TEXTS if t is None or len(t) < 1000] + [
        "a_b-c..d e\x1cf ", "$$$ The The\u2003The", "x", "né'è…ok 12%", "\u0301a b\u00a0c"]
    rows = [[zlib.crc32(w.encode()) % quality.VOCABULARY for w in re.findall(r"\w+|[^\w\s]+", t)] for t in texts]
    got = list(quality.word_rows([t.encode() for t in texts]))
    assert np.concatenate([r for r, _ in got]).tolist() == [r for x in rows for r in x]
    assert np.concatenate([n for _, n in got]).tolist() == [len(x) for x in rows]
    index, sums = quality.index_vectors(), np.zeros((quality.VOCABULARY, quality.WIDTH), np.int32)
    want = np.zeros_like(sums)
    for r, n in got:
        quality.neighbour_sums(r, n, index, sums)
    for x in rows:
        for i, r in enumerate(x):
            for j in range(max(0, i - 2), min(len(x), i + 3)):
                if i != j:
                    want[r] += index[x[j]]
    assert (sums == want).all() and want.any()
    vectors = np.random.default_rng(0).normal(size=(quality.VOCABULARY, 4)).astype(np.float32)
    for x, out in zip(rows, quality.pooled([t.encode() for t in texts], vectors), strict=True):
        v = vectors[x].astype(float)
        near = (v[1:] * v[:-1]).sum(0) / max(1, len(v))
        assert out == pytest.approx(np.r_[v.mean(0), v.std(0), near] if len(v) else np.zeros(12), abs=1e-6)


def test_word_vectors_do_not_depend_on_partitions(spark):
    texts = [(" ".join(f"w{(i * k) % 37}" for k in range(i % 9)),) for i in range(80)] + [(None,), ("one",)]
    df = spark.createDataFrame(texts, "text string")
    one, many = (quality.word_vectors(df.repartition(n)) for n in (1, 9))
    assert one.any() and (one == many).all()


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1/"
    scored = quality.score_documents(spark.read.parquet(d + "documents.parquet"), spark.read.parquet(d + "labels.parquet"))
    m = scored.where("held_out").join(spark.read.parquet(d + "labels.parquet"), "doc_id").toPandas()
    assert ((m.predicted == m.quality).mean()) > 0.99
    assert (m[m.quality == 1].predicted == 1).mean() > 0.99


def test_url_filter(spark):
    urls = ["http://a.Example.NET/en/x?q", "http://net", "x://net/", "https://example.com/de/#a", "https://example.com/de",
            "http://a.org/fr/casino", "http://my.casino.com/", "http://xcasino.com/a", None, "no scheme/net/", "",
            "http://notexample.com/de/", "http://b.org/x?u=http://net/", "http://é.net/é", "http://h/" + "a/" * 50_000 + "poker"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path[:9], r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert got == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("net", "", None, "allow"),
        2: ("net", "/", "net/", "block"), 3: ("example.com", "/de/", "example.com/de/", "block"),
        4: ("example.com", "/de", None, "allow"), 5: ("a.org", "/fr/casin", "org/fr/", "allow"),
        6: ("my.casino.com", "/", None, "block"), 7: ("xcasino.com", "/a", None, "allow"), 8: ("", "", None, "allow"),
        9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("notexample.com", "/de/", None, "allow"),
        12: ("b.org", "/x", None, "allow"), 13: ("é.net", "/é", "net/", "block"), 14: ("h", "/a/a/a/a/", None, "block")}
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_url_filter_borders_are_those_of_the_sql(spark):
    urls = [f"http://{host}/{path}" for host in ("h.org", "ads.org", "éads.org", "xads.org", "Ads.org", "a.éNET")
            for path in ("", "Xads/", "éads/", "adsX", "xads/", "Casino/", "POKER", "pokeR", "a/ads", "ads2", "日ads本", "de/ads")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(map(tuple, url_filter.judge_urls(pages).collect()), key=lambda r: r[0])
    with duckdb.connect() as con:
        con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
        con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
        want = sorted(con.execute(url_filter.oracle_sql()).fetchall(), key=lambda r: r[0])
    assert got == want
    verdicts = {urls[r[0]]: r[4] for r in got}
    assert verdicts["http://h.org/éads/"] == verdicts["http://h.org/Casino/"] == verdicts["http://h.org/pokeR"] == "block"
    assert verdicts["http://h.org/Xads/"] == "allow"


def test_url_phrases_outrank_words_and_rows_repeat(spark):
    paths = ["Online-Casino/x", "casino-online", "sex-education", "Sex/Education?x", "sex_education_sex", "adult--education",
             "ADULT_LITERACY/adult", "bug/tracker", "tracker", "free/movies/online", "free/movies", "casino/royale/film",
             "live.cams", "livecams", "spam-filter-spam", "poker.history/casino-bonus", "a/" * 3000 + "online/casino"]
    urls = [(i % 7, f"https://{host}/{p}") for i, p in enumerate(paths) for host in ("h.org", "x.org", "ads.h.org")] * 2
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = sorted(map(tuple, url_filter.judge_urls(pages).collect()))
    with duckdb.connect() as con:
        con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
        con.executemany("INSERT INTO pages VALUES (?, ?)", urls)
        assert got == sorted(con.execute(url_filter.oracle_sql()).fetchall()) and len(got) == len(urls)
    verdict = {r[2][1:]: r[4] for r in got if r[1] == "h.org"}
    assert [p for p in paths if len(p) < 100 and verdict[p.split("?")[0]] == "allow"] == [
        "sex-education", "Sex/Education?x", "sex_education_sex", "adult--education", "ADULT_LITERACY/adult", "bug/tracker",
        "free/movies", "casino/royale/film", "livecams", "spam-filter-spam", "poker.history/casino-bonus"]
    # Each rule is filed once, under a literal of its own; the rarest of a phrase's words.
    index = url_filter.rule_index(url_filter._parsed(pages), url_filter.RULES)
    assert sorted(r.pattern for own in index.values() for r in own) == sorted(r.pattern for r in url_filter.RULES)
    assert all(token in r.literals for token, own in index.items() for r in own)
    assert sum(len(r.literals) > 1 for r in url_filter.RULES) > 50


PAGE = """<html><head><title>T</title><style>p{}</style><script>x="<p>no</p>"</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, really; please agree to all of them now.</p></div>
<main><article><h1>Head &amp; line</h1><p>First   paragraph,\nwith <b>bold text, and <i>more.</i><br>Next line; here.
<p>Second paragraph, of some length, with commas, and so on; it goes on.<div class="ad">Buy this, now, cheap!</div>
<ul><li>One point, made.<li>Two points, made.</ul><form><input name=a>Search, please, here.<select><option>o</select></form>
<blockquote>Quoted, text &lt;here&gt;.</blockquote></article>
<section id="comments"><p>Reader comment, that is rather long, and has, many, commas.</p></section></main>
<aside><p>Sidebar text, of length, with commas, too.</p></aside><footer>&copy; me</footer><!-- c --></body></html>"""


def test_html():
    assert html_extract.extract(PAGE) == "\n".join([
        "Head & line", "First paragraph, with bold text, and more. Next line; here.",
        "Second paragraph, of some length, with commas, and so on; it goes on.", "One point, made.", "Two points, made.",
        "Quoted, text <here>."])
    body = "".join(f"<p>Paragraph {i}, long enough, with words and commas, to be content.</p>" for i in range(5))
    assert html_extract.extract(f"<body><div class=menu>a, b, c</div><div class=x>{body}</div><div>x</div>").count("\n") == 4
    for empty in (None, "", "<p>", "<!-- x", "<script>a", "<nav><a>b</a></nav>"):
        assert html_extract.extract(empty) == ""
    assert html_extract.extract("plain text, only &lt;") == "plain text, only <"
    assert len(html_extract.extract("<article>" + "<p>some words, here.</p>" * 20_000)) == 20_000 * 18 - 1


def paragraphs(name, n):
    return "".join(f"<p>{name} {i}, long enough, with words and commas, to be content.</p>" for i in range(n))


def lines(name, n):
    return re.sub("</p>(?=<p>)", "\n", paragraphs(name, n)).replace("<p>", "").replace("</p>", "")


def test_html_keeps_all_content_elements():
    nav = "<nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>"
    both = lines("A", 8) + "\n" + lines("B", 2)
    for first, second in (("section", "section"), ("div", "div"), ("div", "section"), ("article", "article")):
        page = f"<body>{nav}<{first}>{paragraphs('A', 8)}</{first}><{second}>{paragraphs('B', 2)}</{second}></body>"
        assert html_extract.extract(page) == both
    title = "<h1>The title</h1>"
    two = f"<article>{paragraphs('A', 8)}</article><article>{paragraphs('B', 2)}</article>"
    assert html_extract.extract(f"<body>{nav}<main>{title}{two}</main></body>") == "The title\n" + both
    for inner in ("article", "div"):
        page = f"<body>{nav}{title}<{inner}>{paragraphs('A', 8)}</{inner}><footer>(c), me, 2020.</footer></body>"
        assert html_extract.extract(page) == "The title\n" + lines("A", 8)


def test_html_names_are_whole():
    text, want = paragraphs("A", 6), lines("A", 6)
    for attributes in ('style="overflow:hidden"', 'data-hidden="false"', 'title="The hidden cost"', 'aria-hidden="false"',
                       'class="overflow-hidden"', 'class="no-sidebar x"', "class='has-sidebar'", "class=legal-form",
                       'id="top"', 'id="related-work"', 'id="discussion"', 'data-class="ad"', 'data-x="a" title=" class=ad "'):
        for page in (f"<div {attributes}><article>{text}</article></div>", f"<div {attributes}>{text}</div>",
                     f"<article>{paragraphs('B', 20)}<section {attributes}>{text}</section></article>"):
            assert html_extract.extract(f"<body>{page}</body>").endswith(want), (attributes, page[:80])
    page = f'<article>{text}<h2 id="related">Related work</h2>{text}<h2 id="comments">Comments</h2>{text}</article>'
    assert html_extract.extract(page) == f"{want}\nRelated work\n{want}\nComments\n{want}"


def test_html_wrappers_are_not_out():
    text, want = paragraphs("A", 6), lines("A", 6)
    other = "<p>Other text, of the page, that is outside, of it.</p>"
    for wrapper in ("form", "div class=widget", "div class='modal x'", "div hidden", "aside", "div aria-hidden=true"):
        end = wrapper.split()[0]
        assert html_extract.extract(f"<body><{wrapper}>{text}</{end}></body>") == want
        for main in ("main", "div role=main"):
            page = f"<body><{wrapper}><{main}>{text}</{main.split()[0]}></{end}></body>"
            assert html_extract.extract(page) == want
        # Beside an article the same element is something else, also if it is longer.
        page = f"<body><article>{text}</article><{wrapper}>{other * 20}</{end}></body>"
        assert html_extract.extract(page) == want
        assert html_extract.extract(f"<article>{text}<{wrapper}>{other}</{end}</article>") == want


def test_html_raw_elements_end_where_they_do():
    text, want = paragraphs("A", 3), lines("A", 3)
    for raw in ("<script>a</SCRIPT>", "<style>a</style >", "<script>'</scripted>'</script\n>"):
        for n in (1, 7, 60, 2000):  # lower() makes each of these letters two
            page = f"<article><p>{'\u0130' * n} il, bu.</p>{raw}{text}{raw}{text}</article>"
            assert html_extract.extract(page) == f"{'\u0130' * n} il, bu.\n{want}\n{want}"


def test_html_links_of_the_article_stay():
    text, want = paragraphs("A", 6), lines("A", 6)
    links = "<ul><li><a href=a>First link, of a list</a><li><a href=b>Second link</a></ul>"
    page = f"<article><h1><a href=x>A linked title</a></h1>{text}{links}</article>"
    assert html_extract.extract(f"<body>{links}{page}{links}</body>") == (
        f"A linked title\n{want}\nFirst link, of a list\nSecond link")
    # Without an article: a linked heading and a linked item among others stay, a list of links goes.
    some = "<ul><li>One item, with some words<li><a href=a>Linked item</a><li>Other item, with more words</ul>"
    page = f"<body><div>{text}<h2><a href=x>Linked head</a></h2>{text}{some}</div><div>{links}</div></body>"
    assert html_extract.extract(page) == (
        f"{want}\nLinked head\n{want}\nOne item, with some words\nLinked item\nOther item, with more words")


def test_html_threshold_decides():
    text, want = paragraphs("A", 8), lines("A", 8)
    for poor in ("<p>Sign up</p>", "<div>Sign up</div>", "<ul><li>Up</ul>", "<h3>Popular</h3>"):
        page = f"<body><div class=a>{text}</div><div class=x>{poor * 9}</div><div class=b>{text}</div></body>"
        got = html_extract.extract(page).split("\n")
        assert len(got) < 16 + 9 and [g for g in got if g.startswith("A")] == 2 * want.split("\n"), poor
    # Paragraphs with sentences and lists stay however long the rest is; a list's items count together.
    short = "<p>A short paragraph, as in a talk. It has two sentences.</p>" * 9
    items = "<ul>" + "".join(f"<li>item {i}" for i in range(9)) + "</ul>"
    page = f"<div><section class=a>{short}</section>{paragraphs('A', 400)}{'word, ' * 20_000}{items}</div>"
    got = html_extract.extract(page).split("\n")
    assert len(got) == 9 + 401 + 9 and got[-1] == "item 8"


def test_html_ratios_decide_within_articles(monkeypatch):
    """Lines of containers go by their path's ratios; with the thresholds off they stay."""
    body = "".join(f"<p>Paragraph {i}, with words, commas, and more; it is long enough to be text.</p>" for i in range(6))
    page = (f"<body><article><h1>Title</h1><div class=tools>Print</div>{body}<div class=tools>Save</div><p>Short.</p>"
            "<div>A line of its own, with a comma, and a full stop at its end. And one more.</div><pre>x = 1</pre>"
            "<table><tr><td>7</table><div class=tools>Send</div></article></body>")
    got = html_extract.extract(page).split("\n")
    assert [x for x in got if not x.startswith("Paragraph")] == [
        "Title", "Short.", "A line of its own, with a comma, and a full stop at its end. And one more.", "x = 1", "7"]
    monkeypatch.setattr(html_extract, "ARTICLE_THRESHOLD", 0.0)
    assert {"Print", "Save", "Send"} <= set(html_extract.extract(page).split("\n"))


@pytest.mark.parametrize("extra", [
    '<div class="sponsored-box">Buy this, it is cheap, and good, and new.</div>', '<p class="ad_unit">Buy, now, cheap, here.</p>',
    '<div class="notice"><p>We moved, please update, your bookmarks.</p></div>', '<div class=alert>Old, page, beware, reader.</div>',
    '<article class="reader-comment"><p>I agree, mostly, with all of this.</p></article>',
    '<section class="comments"><article><p>So do I, and I, said so, before.</p></article></section>'])
def test_html_adverts_notices_and_comments_within_articles_go(extra):
    page = f"<main><article><h1>Title</h1>{paragraphs('One', 3)}{extra}{paragraphs('Two', 3)}</article></main>"
    assert html_extract.extract(page) == html_extract.extract(page.replace(extra, ""))
    outside = f"<article><h1>Title</h1>{paragraphs('One', 6)}</article><div class=legal><p>We use cookies, so, click, here.</p></div>"
    assert "cookies" not in html_extract.extract(outside)


def test_html_tags_side_and_noscript_within_articles_stay():
    page = (f"<article><h1>Title</h1>{paragraphs('One', 3)}<p class=tags>Tags, of the, trade.</p><div class=side><p>Beside, "
            f"the point.</p></div><noscript><p>Shown, without, scripts.</p></noscript></article><noscript><p>Turn, it, on.</p>")
    got = html_extract.extract(page)
    assert all(x in got for x in ("Tags, of", "Beside, the", "Shown, without")) and "Turn, it" not in got


def test_html_query(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (1, "u", PAGE, 1), (None, "v", "", 1)],
                                  "page_id long, url string, html string, text int")
    rows = html_extract.main_text(pages).collect()
    assert sorted(r.n_chars for r in rows) == sorted([0, 0, len(html_extract.extract(PAGE))])
    assert html_extract.main_text(pages.limit(0)).count() == 0
