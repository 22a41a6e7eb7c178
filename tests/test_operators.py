"""Operators on small documents, files and streams."""

import glob
import itertools
import json
import os
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from pagelens import highlighter
from pagelens.functions import analysis as A
from pagelens.highlighter import Highlighter, snippets
from pagelens.operators import boxes as B
from pagelens.operators import index as I
from pagelens.operators import passages as P
from pagelens.operators import query as Q
from pagelens.operators import sinks as K
from pagelens.operators import snippets as S
from pagelens.options import HighlightOptions
from pagelens.sources import pointer as R

SHY = "­"


def mini(lines, page="p1"):
    out = f'<p xml:id="{page}" wh="800 800"><b>'
    for y, line in enumerate(lines):
        out += "<l>" + "".join(f'<w x="{x * 100} {y * 40} 90 30">{w}</w> ' for x, w in enumerate(line.split())) + "</l>"
    return out + "</b></p>"


def search(spark, markup, text, options=None, **kw):
    o = options or HighlightOptions(snippets=5, norm="none")
    b = B.boxes(spark.createDataFrame([(1, markup)], "doc_id LONG, markup STRING"))
    m = Q.matches(I.postings(b), Q.parse(text), weight_matches=o.weight_matches, **kw)
    w = S.words(P.best(P.scored(P.numbered(P.bounded(m, I.units(b), o)), o), o), b, S.spans(m), o).cache()
    r = S.regions(w, o)
    return [x.text for x in S.texts(w).orderBy("rank").collect()], r.orderBy("rank", "region").collect(), S.merged_lines(S.highlights(w, r, o), r).orderBy("rank", "span_id", "line").collect()


def test_phrase_over_two_lines(spark):
    texts, regions, hl = search(spark, "<ocr>" + mini(["one two three", "four five six"]) + "</ocr>", '"three four"', HighlightOptions(norm="none", weight_matches=True))
    assert texts == ["one two <em>three four</em> five six"]
    assert len(regions) == 1 and (regions[0].ulx, regions[0].lry) == (0, 70)
    assert [h.text for h in hl] == ["three", "four"] and len({h.span_id for h in hl}) == 1


def test_span_across_pages_closes_its_tags(spark):
    m = "<ocr>" + mini(["a b", "c d"], "p1") + mini(["e f"], "p2") + "</ocr>"
    _, regions, _ = search(spark, m, '"d e"', HighlightOptions(norm="none", weight_matches=True, limit_block="none"))
    assert [(r.page_id, r.text) for r in regions] == [("p1", "a b c <em>d</em>"), ("p2", "<em>e</em> f")]


def test_two_columns(spark):
    left = "".join(f'<l><w x="0 {y * 40} 90 30">l{y}</w> </l>' for y in range(8))
    right = "".join(f'<l><w x="500 {y * 40} 90 30">r{y}</w> </l>' for y in range(2))
    _, regions, _ = search(spark, f'<ocr><p xml:id="p"><b>{left}{right}</b></p></ocr>', "l7", HighlightOptions(norm="none", context_size=1))
    assert [(r.ulx, r.text) for r in regions] == [(0, "l6 <em>l7</em>"), (500, "r0")]


def test_hyphenated_word_is_found_whole_and_taken_in(spark):
    m = f'<ocr><p xml:id="p"><b><l><w x="0 0 9 9">the</w> <w x="10 0 9 9">hy{SHY}</w></l><l><w x="0 20 9 9">phen</w> <w x="10 20 9 9">here</w></l></b></p></ocr>'
    texts, _, hl = search(spark, m, "hyphen", HighlightOptions(norm="none", context_size=0))
    assert texts == ["the <em>hyphen</em>"]
    assert [h.text for h in hl] == ["hy", "phen"]


def test_relative_coordinates(spark):
    m = '<ocr><p xml:id="p"><b><l><w x=".1 .1 .2 .1">aa</w> <w x=".4 .1 .2 .1">bb</w></l></b></p></ocr>'
    _, _, hl = search(spark, m, "bb")
    assert [(round(h.ulx, 4), round(h.lrx, 4)) for h in hl] == [(0.6, 1.0)] or hl[0].ulx == pytest.approx(0.6, abs=2e-4)


def test_alternatives_share_a_position(spark):
    m = '<ocr><p><b><l><w x="1 1 2 2">merry</w> <w x="4 1 2 2">clistrias⇿christmas</w> <w x="7 1 2 2">all</w></l></b></p></ocr>'
    b = B.boxes(spark.createDataFrame([(1, m)], "doc_id LONG, markup STRING"))
    p = I.postings(b)
    assert {(r.term, r.pos, r.is_alt) for r in p.collect()} == {("merry", 0, False), ("clistrias", 1, False), ("christmas", 1, True), ("all", 2, False)}
    assert Q.phrase_spans(p, ("merry", "christmas", "all")).count() == 1


@pytest.mark.parametrize(
    ("text", "want"),
    [("apple", {1, 2}), ("apple AND pear", {2}), ("pear OR fig", {2, 3}), ("fruit NOT apple", {3}), ("+apple -pear", {1}), ('"red apple"', {1}), ('"apple red"~2', {1}), ('"red pear"~1', set()), ("app*", {1, 2}), ("f?g", {3}), ("aple~1", {1, 2}), ("*", set()), ("zzz*", set()), ("(apple OR fig) AND fruit", {1, 2, 3}), ("red-apple", {1})],
)
def test_query_language(spark, text, want):
    docs = [(1, "a red apple fruit"), (2, "apple fruit and pear"), (3, "fig fruit")]
    rows = [(d, t, i, 0, 0, i) for d, s in docs for i, t in enumerate(s.split())]
    p = spark.createDataFrame(rows, "doc_id LONG, term STRING, pos INT, start_off LONG, end_off LONG, box_seq INT")
    assert {r[0] for r in Q.documents(p, Q.parse(text)).collect()} == want


def test_documents_that_cannot_be_read_do_not_fail_the_others(spark):
    rows = [(1, "<ocr>" + mini(["x"]) + "</ocr>"), (2, None), (3, ""), (4, "gibberish"), (5, "<ocr><p><b><l><w x='a b'>q")]
    got = {r.doc_id: (r.error, len(r.boxes)) for r in B.parsed(spark.createDataFrame(rows, "doc_id LONG, markup STRING")).collect()}
    assert got[1] == (None, 1) and got[2] == (None, 0) and got[3] == (None, 0) and got[4] == ("unknown format", 0) and 5 in got
    late = B.parsed(spark.createDataFrame(rows, "doc_id LONG, markup STRING"), time_allowed_ms=0).collect()
    assert all(r.error == "time" and not r.boxes for r in late)


def test_pointers_to_files(spark, tmp_path):
    parts = ["ene mene mist", "äes rappelt in der kist", "äene mene mäck", "und du bist wäg"]
    names = []
    for i, t in enumerate(parts):
        names.append(str(tmp_path / f"part_{i}"))
        (tmp_path / f"part_{i}").write_bytes(t.encode())
    bom = tmp_path / "bom"
    bom.write_bytes(b"\xef\xbb\xbfhello")
    (tmp_path / "empty").write_bytes(b"")
    rows = [(1, "+".join(names)), (2, f"{names[0]}[9:]+{names[1]}[3:10]"), (3, f"{names[0]}[8:10,0:3]"), (4, str(bom)), (5, str(tmp_path / "gone")), (6, str(tmp_path / "empty"))]
    out = {r.doc_id: r for r in R.load(spark, spark.createDataFrame(rows, "id LONG, ptr STRING"), "id", "ptr").withColumn("at", R.source_offset(F.col("pieces"), F.lit(14))).collect()}
    assert bytes(out[1].content).decode() == "".join(parts)
    assert bytes(out[2].content) == parts[0].encode()[9:] + parts[1].encode()[3:10]
    assert bytes(out[3].content) == parts[0].encode()[0:3] + parts[0].encode()[8:10]
    assert bytes(out[4].content) == b"hello"
    assert out[5].content is None and "missing" in out[5].error and "empty" in out[6].error
    assert out[1]["at"] == 14


def test_index_round_trip_reads_only_the_term(spark, tmp_path):
    b = B.boxes(spark.createDataFrame([(1, "<ocr>" + mini(["b a", "a c"]) + "</ocr>")], "doc_id LONG, markup STRING"))
    I.write(I.postings(b), str(tmp_path / "ix"), 2)
    back = I.read(spark, str(tmp_path / "ix")).filter("term = 'a'")
    assert back.count() == 2
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,a)]" in back._jdf.queryExecution().toString()


def test_top_passages_are_limited_in_each_partition(spark):
    from pagelens.plans import catalog

    q = catalog.passages_scored_topk(spark, "/root/testdata/sf0.001")
    assert "WindowGroupLimit" in q._jdf.queryExecution().toString()


def test_converter_and_manifest(spark):
    m = "<ocr>" + mini(["a &amp; b", "c"], "p1") + mini(["d"], "p2") + "</ocr>"
    b = B.boxes(spark.createDataFrame([(1, m)], "doc_id LONG, markup STRING"))
    again = B.boxes(K.to_miniocr(b))
    cols = ["box_seq", "text", "trailing", "ulx", "uly", "lrx", "lry", "page_id", "line_seq", "block_seq"]
    assert again.select(cols).collect() == b.select(cols).collect()
    assert '"label":"p2"' in K.manifests(b).first().manifest


def test_stream_of_files_to_postings(spark, tmp_path):
    from pagelens.streaming import ingest

    drop, out = tmp_path / "drop", str(tmp_path / "postings")
    drop.mkdir()
    (drop / "a.xml").write_text("<ocr>" + mini(["hello world"]) + "</ocr>")
    ingest.run_once(spark, str(drop), out, str(tmp_path / "check"))
    (drop / "b.xml").write_text("<ocr>" + mini(["hello again"]) + "</ocr>")
    ingest.run_once(spark, str(drop), out, str(tmp_path / "check"))
    p = spark.read.parquet(out)
    assert p.filter("term = 'hello'").count() == 2 and p.filter("term = 'again'").count() == 1


def test_catalogue_agrees_with_sql_on_the_smallest_tables(spark):
    duckdb = pytest.importorskip("duckdb")
    from pagelens.plans import catalog

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in glob.glob(d + "/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    for name in ("boxes_roundtrip", "boxes_alto", "postings_full", "q_sloppy", "passages_numtotal", "snippet_text", "snippet_regions", "highlight_line_merge"):
        df = catalog.QUERIES[name](spark, d)
        got = sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect())
        rel = con.sql(catalog.ORACLE_SQL[name])
        at = [rel.columns.index(c) for c in sorted(rel.columns)]
        assert got == sorted(str([r[i] for i in at]) for r in rel.fetchall()), name


def test_the_rest_imports_without_the_llm_package(tmp_path):
    import shutil
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", ".pytest_cache"))
    code = "import __spark_entry__ as e; assert 'q_term' in e.queries() and 'pipeline' not in e.queries() and not any(k.startswith('op1') for k in e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})


@pytest.fixture(scope="module")
def small_index(spark, tmp_path_factory):
    docs = spark.createDataFrame([(i, t, "Plain $5 text. The cat (sat). No " + t) for i, t in enumerate(["the cat sat on the mat", "the dog sat", "cat cat cat", "a running cat runs on"])], "doc_id LONG, body STRING, note STRING")
    m = docs.select("doc_id", F.concat(F.lit("<ocr><p xml:id='p' wh='800 800'><b><l>"), F.array_join(F.transform(F.split("body", " "), lambda w, i: F.concat(F.lit('<w x="'), (i * 100).cast("string"), F.lit(' 0 90 30">'), w, F.lit("</w> "))), ""), F.lit("</l></b></p></ocr>")).alias("markup"))
    path = str(tmp_path_factory.mktemp("ix"))
    return I.build(B.boxes(m), path, A.Analysis.chain("ocr", "standard", "alternatives", "lowercase", "porter"), 2), docs


def test_a_request_from_parameters_to_json(small_index):
    index, docs = small_index
    h = Highlighter(index, stored=docs)
    r = h.search({"q": 'ocr_text:cat AND "sat on"', "hl": "on", "hl.weightMatches": "true", "fl": "note", "hl.fl": "note ocr_*"})
    out = json.loads(r.json())
    assert [x["doc_id"] for x in out["response"]["docs"]] == [0] and "partialOcrHighlights" not in out
    got = out["ocrHighlighting"]["0"]["ocr_text"]
    assert got["numTotal"] == 1 and got["snippets"][0]["text"] == "the <em>cat</em> <em>sat on</em> the mat" and got["snippets"][0]["pages"] == [{"id": "p"}]
    assert [x["text"] for x in got["snippets"][0]["highlights"][1]] == ["sat on"]
    assert out["highlighting"]["0"]["note"] == ["The <em>cat</em> (<em>sat</em>)"]
    # The query is stemmed like the index, and documents are ranked.
    assert [x["doc_id"] for x in json.loads(h.search({"q": "runs"}).json())["response"]["docs"]] == [3]
    assert [r["doc_id"] for r in h.find({"q": "cat", "rows": 2, "start": 0}).collect()][0] == 2
    assert {r["doc_id"] for r in h.find({"q": "cat", "fq": ["sat", "the"]}).collect()} == {0}
    assert [r["doc_id"] for r in h.find({"q": "dog^20 cat", "rows": 1}).collect()] == [1]
    other = h.search({"q": "cat", "hl": "on", "hl.q": "mat", "rows": 4})
    assert [x[0] for x in other.highlighting.collect()] == [0]
    simple = h.search({"q": "cat", "hl": "on", "hl.q": '"mat dog"', "hl.qparser": "simple", "rows": 4})
    assert [x[0] for x in simple.highlighting.collect()] == [0]
    near = h.search({"q": "dog", "hl": "on", "hl.ocr.contextBlock": "word", "hl.ocr.contextSize": 1})
    assert json.loads(near.highlighting.first()[1])["ocr_text"]["snippets"][0]["text"] == "the <em>dog</em> sat"


def test_time_that_is_up_makes_a_partial_response(small_index):
    index, _ = small_index
    r = Highlighter(index).search({"q": "cat", "hl": "on", "timeAllowed": 0})
    assert r.partial and r.highlighting.count() == 0 and json.loads(r.json())["partialOcrHighlights"] is True
    ticks = iter(range(0, 1000, 4))
    r = Highlighter(index, clock=lambda: next(ticks)).search({"q": "cat", "hl": "on", "hl.ocr.timeAllowed": 30_000, "timeAllowed": 9_000}, batch=1)
    assert r.partial and r.highlighting.count() == 2  # the clock goes on by four seconds for each document
    assert not Highlighter(index).search({"q": "cat", "hl": "on", "timeAllowed": 600_000}).partial


def test_alternatives_survive_as_far_as_the_tokenizer_lets_them(spark):
    word = lambda text, *alts: (text, [(a, 100 * (i + 1)) for i, a in enumerate(alts)])
    words = [word("YoB", "OB"), word("pur-chased", "purchased"), word("cattle", "cat-tlc", "cattlc"), word("(x", "y"), word("a" * 100, "b" * 100, "c" * 100)]
    rows = [(1, i, t, 10 * i, len(t), a) for i, (t, a) in enumerate(words)]
    b = spark.createDataFrame(rows, "doc_id LONG, box_seq INT, text STRING, text_off LONG, src_len INT, alternatives ARRAY<STRUCT<text: STRING, off: LONG>>")
    got = sorted((r.pos, r.is_alt, r.term, r.start_off) for r in I.postings(b).collect())
    assert got == [(0, False, "yob", 0), (0, True, "ob", 100), (1, False, "pur", 10), (2, False, "chased", 14), (3, False, "cattle", 20), (3, True, "cat", 100), (4, False, "x", 31), (5, False, "a" * 100, 40), (5, True, "b" * 100, 100)]


@pytest.mark.parametrize("steps", [("standard", "alternatives"), ("ocr", "standard", "lowercase", "alternatives"), ("ocr", "lowercase"), ("ocr", "standard", "what")])
def test_chains_that_make_no_sense_are_refused(steps):
    with pytest.raises(ValueError):
        A.Analysis.chain(*steps)
    assert A.Analysis.chain("ocr", "whitespace", "alternatives", "stop").stop_words == tuple(A.STOP_WORDS)


@pytest.mark.parametrize(("term", "most"), [("abcd", 1), ("abcd", 2), ("aab", 2), ("ab", 2)])
def test_fuzzy_terms_count_a_change_of_places_once(spark, term, most):
    def osa(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    terms = ["".join(t) for n in range(1, 6) for t in itertools.product("abcd", repeat=n)]
    got = {r[0] for r in spark.createDataFrame([(t,) for t in terms], "term STRING").filter(Q.term_condition(Q.Term(term, fuzzy=most))).collect()}
    assert got == {t for t in terms if osa(t, term) <= most}


def test_one_passage_is_built_behind_the_limit(spark):
    lines = ["hit a", "x", "hit b", "x", "hit c hit d", "x", "hit e"]
    o = HighlightOptions(snippets=2, max_passages=2, context_size=0, norm="none", limit_block="none")
    b = B.boxes(spark.createDataFrame([(1, "<ocr>" + mini(lines) + "</ocr>")], "doc_id LONG, markup STRING"))
    n = P.numbered(P.bounded(Q.matches(I.postings(b), Q.parse("hit")), I.units(b, "line"), o))
    assert [(r.passage_no, r.n_matches) for r in P.passages(n, o).orderBy("passage_no").collect()] == [(1, 1), (2, 1), (3, 1)]
    assert P.totals(n, o).first().num_total == 2 + 3


def test_annotations_of_all_hits_of_a_snippet(spark):
    o = HighlightOptions(norm="none", absolute_highlights=True, tag_pre="[[", tag_post="]]")
    b = B.boxes(spark.createDataFrame([(1, "<ocr>" + mini(["a X, b Y c"]) + "</ocr>")], "doc_id LONG, markup STRING"))
    w, _ = snippets(Q.matches(I.postings(b), Q.parse("x y")), I.units(b, "line"), b, o)
    r = S.regions(w, o)
    a = K.annotations(S.texts(w), S.merged_lines(S.highlights(w, r, o), r), r, options=o).orderBy("span_id").collect()
    assert [(x.before, x.match, x.after, x.chars) for x in a] == [("a ", "X", ", b Y c", "X,"), ("a X, b ", "Y", " c", "Y")]


def test_a_registered_format_and_the_table_function(spark):
    from pagelens.functions import markup as M

    class Lines(M._Handler):
        def run(self, markup):
            self.page(M.Page("one"))
            for i, w in enumerate(markup.removeprefix("#words ").split()):
                self.begin(M.Box(w, i, len(w), " ", i, 0, i + 1, 1))

    M.register(M.Format("words", re.compile("^#words"), Lines, True), before="hocr")
    try:
        b = B.boxes(spark.createDataFrame([(1, "#words a b"), (2, "<ocr>" + mini(["c"]) + "</ocr>")], "doc_id LONG, markup STRING"))
        assert sorted((r.doc_id, r.format, r.text) for r in b.collect()) == [(1, "words", "a"), (1, "words", "b"), (2, "miniocr", "c")]
        highlighter.register(spark)
        assert [r.text for r in spark.sql("SELECT * FROM ocr_words('#words x y')").collect()] == ["x", "y"]
    finally:
        M.FORMATS[:] = [f for f in M.FORMATS if f.name != "words"]


def test_searches_read_only_documents_that_were_found(small_index):
    index, _ = small_index
    few = F.col("doc_id").isin([1, 2])
    w, _ = snippets(Q.matches(index.postings.filter(few), Q.parse("cat")), index.units.filter(few), index.boxes.filter(few), HighlightOptions())
    plan = w._jdf.queryExecution().toString()
    scans = [x for x in plan.splitlines() if "PushedFilters" in x or "FileScan parquet" in x]
    assert scans and all("In(doc_id" in x or "doc_id IN" in x for x in scans if "FileScan" in x)


def test_mined_phrases_against_a_counter(spark):
    from collections import Counter

    from pagelens.operators import mining

    g = random.Random(1)
    docs = [[g.choice(["aa", "bbbb", "cccc", "dd"]) for _ in range(g.randint(0, 60))] for _ in range(12)] + [None, []]
    got = {(r.n, r.gram): (r.df, r.tf) for r in mining.phrases(spark.createDataFrame([(w,) for w in docs], "words ARRAY<STRING>"), block=10, least_count=2, least_docs=2, longest=4).collect()}
    df, tf = Counter(), Counter()
    for w in docs:
        own = Counter()
        for s in range(0, len(w or []), 10):
            part = w[s : s + 10]
            for n in range(2, 5):
                for i in range(len(part) - n + 1):
                    if any(len(x) >= 4 for x in part[i : i + n]):
                        own[n, " ".join(part[i : i + n])] += 1
        for k, c in own.items():
            if c >= 2:
                df[k] += 1
                tf[k] += c
    assert got == {k: (df[k], tf[k]) for k in df if df[k] >= 2}


def test_scored_sentences_of_plain_text(spark):
    docs = spark.createDataFrame([(1, "A cat. The (cat) and a c.t! No dog here"), (2, None), (3, "")], "doc_id LONG, text STRING")
    got = S.sentences(docs, ["c.t", "cat"], scored=True, options=HighlightOptions(snippets=5, tag_pre="$1[", tag_post="]\\"))
    assert {r.text for r in got.collect()} == {"A $1[cat]\\", "The ($1[cat]\\) and a c"}
    assert S.sentences(docs, []).count() == 0


def test_folders_and_many_files(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for i in range(12_000):
        (tmp_path / "many" / f"f{i}").write_bytes(b"x%d" % i)
    df = spark.range(12_000).select("id", F.concat(F.lit(f"{tmp_path}/many/f"), F.col("id").cast("string")).alias("ptr"))
    got = R.load(spark, df, "id", "ptr")
    assert got.filter("error IS NULL AND cast(content AS string) = concat('x', doc_id)").count() == 12_000
    odd = spark.createDataFrame([(1, f"{tmp_path}/many"), (2, f"{tmp_path}/nowhere/f1"), (3, f"{tmp_path}/many/f3")], "id LONG, ptr STRING")
    errors = {r.doc_id: r.error for r in R.load_folder(spark, odd, "id", "ptr", [f"{tmp_path}/many", f"{tmp_path}/nowhere"]).collect()}
    assert errors[1].startswith("unsupported") and errors[2].startswith("missing") and errors[3] is None


def test_issues_become_articles_with_pointers(spark):
    from pagelens.sources import mets

    ns = 'xmlns:mets="http://www.loc.gov/METS/" xmlns:mods="http://www.loc.gov/mods/v3" xmlns:xlink="http://www.w3.org/1999/xlink"'
    section = lambda i, body: f'<mets:dmdSec ID="{i}"><mets:mdWrap><mets:xmlData><mods:mods>{body}</mods:mods></mets:xmlData></mets:mdWrap></mets:dmdSec>'
    area = lambda f, b: f'<mets:fptr><mets:area FILEID="{f}" BEGIN="{b}"/></mets:fptr>'
    issue = f"""<mets:mets {ns}>{section("MODSMD_PRINT", "<mods:titleInfo><mods:title>News</mods:title><mods:partNumber>7</mods:partNumber></mods:titleInfo><mods:originInfo><mods:dateIssued>1900-01-02</mods:dateIssued></mods:originInfo>")}
    {section("MODSMD_ARTICLE1", "<mods:titleInfo><mods:title>One</mods:title></mods:titleInfo><mods:name><mods:namePart>Ann</mods:namePart></mods:name>")}
    <mets:fileSec><mets:fileGrp USE="Text"><mets:file ID="F1"><mets:FLocat xlink:href="file://./text/p1.xml"/></mets:file><mets:file ID="F2"><mets:FLocat xlink:href="file://./text/p2.xml"/></mets:file></mets:fileGrp></mets:fileSec>
    <mets:structMap TYPE="LOGICAL"><mets:div TYPE="ISSUE"><mets:div TYPE="ARTICLE" DMDID="MODSMD_ARTICLE1">{area("F1", "B3")}{area("F2", "B9")}{area("F1", "B1")}{area("F1", "B7")}</mets:div></mets:div></mets:structMap></mets:mets>"""
    pages = {"text/p1.xml": '<p>é<TextBlock ID="B1">x</TextBlock> <TextBlock ID="B2">no</TextBlock><TextBlock ID="B3">z</TextBlock></p>'.encode(), "text/p2.xml": b'<TextBlock HPOS="1" ID="B9">y</TextBlock>'}
    a = mets.articles(spark.createDataFrame([("i1", issue), ("i2", "<broken"), ("i3", None)], "issue_id STRING, mets STRING"))
    rows = {r.issue_id: r for r in a.collect()}
    assert set(rows) == {"i1", "i2"} and rows["i2"].error and rows["i1"].article_id == "i1-1"
    assert (rows["i1"].title, rows["i1"].author, rows["i1"].date, rows["i1"].newspaper_title, rows["i1"].newspaper_part) == ("One", "Ann", "1900-01-02T00:00:00Z", "News", "7")
    p = mets.pointers(a, spark.createDataFrame(list(pages.items()), "path STRING, content BINARY"), prefix="/data/").first()
    assert p.missing == 1
    sources = R.parse(p.pointer)
    assert [x.target for x in sources] == ["/data/text/p1.xml", "/data/text/p2.xml"]
    assert [[pages[x.target[6:]][r.start : r.end] for r in x.regions] for x in sources] == [[b'<TextBlock ID="B1">x</TextBlock>', b'<TextBlock ID="B3">z</TextBlock>'], [pages["text/p2.xml"]]]


def test_the_layout_is_local_to_each_document_and_agrees_with_the_index(spark):
    from pagelens.plans import layout as L

    texts = ["  a\tb-c ,, d.e\n\né—ü x ", "", None, " \n", " ".join(f"w{i},é" for i in range(345)), "the end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    b = L.boxes(docs, counted=True, neighbours=True)
    p, u = L.postings(docs), L.units(docs, "line", "block", "page", "word")
    for df in (b, p, u, L.lengths(docs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    plain = b.drop("base", "prv", "nxt")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(p) == rows(I.postings(plain)) == rows(I.postings(b))
    assert rows(u) == rows(I.units(plain, "line", "block", "page", "word"))
    assert rows(L.lengths(docs)) == rows(I.document_lengths(p))
    some = spark.createDataFrame([(0, 1, 3), (4, 5, 9), (4, 8, 12)], "doc_id LONG, p_first INT, p_last INT")
    want = plain.filter("doc_id = 0 AND box_seq BETWEEN 1 AND 3 OR doc_id = 4 AND box_seq BETWEEN 5 AND 12")
    assert rows(L.boxes_in(some, docs)) == rows(want)


def test_a_query_of_terms_reads_the_postings_once(spark):
    from pagelens.plans import layout as L

    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c"), (4, "d a c")], "doc_id LONG, text STRING")
    p = L.postings(docs)
    for text, want in {"a AND b": [1], "a OR c": [1, 2, 3, 4], "(a OR b) AND NOT c": [1], "+c -b": [3, 4], "* OR d": [4], "NOT a": [2, 3], "a OR NOT c": [1], "d* AND c~1": [4]}.items():
        df = Q.documents(p, Q.parse(text))
        plan = df._jdf.queryExecution().executedPlan().toString()  # before it runs: then it has the first plan, too
        assert "NOT" in text and "AND" not in text or plan.count("Generate posexplode") <= 1, text
        assert sorted(r[0] for r in df.collect()) == want, text


def test_a_text_without_words_has_no_markup_and_is_no_bad_document(spark):
    from pagelens.plans import layout as L

    docs = spark.createDataFrame([(1, ""), (2, " \n"), (3, None), (4, "a b")], "doc_id LONG, text STRING")
    for render in (L.miniocr, L.hocr, L.alto):
        got = {r.doc_id: (r.error, len(r.boxes)) for r in B.parsed(render(docs)).collect()}
        assert got == {1: (None, 0), 2: (None, 0), 3: (None, 0), 4: (None, 2)}


def test_one_pass_over_the_texts_finds_what_a_query_needs_of_the_layout(spark):
    from pagelens.plans import layout as L

    texts = ["  a\tOn-c ,, d.on\n\né—ü On x ", "", None, " \n", " ".join(f"w{i},é" if i % 50 else "of the" for i in range(700)), "the end", "É on 𝐀on on", "Kon Of​the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    rows = lambda df: sorted(map(repr, df.collect()))
    p = L.postings(docs)
    for text, level, k in (("on", "line", 2), ('"of the"', "block", 1), ("w1* OR th? OR wnd~2 OR é", "word", 4)):
        q, o = Q.parse(text), HighlightOptions(context_block=level, context_size=k, limit_block="page", weight_matches=True)
        near = L.Near(docs, Q.leaves(q), level, k, "words")
        m = Q.matches(near.postings(), q, weight_matches=True)
        assert rows(m) == rows(Q.matches(p, q, weight_matches=True)) and m.count(), text
        want = P.bounded(m, L.units(docs, level), o)
        assert rows(P.bounded(m, near.units(), o)) == rows(want), text
        bounds = want.select("doc_id", "p_first", "p_last").distinct()
        assert rows(near.boxes_in(bounds)) == rows(L.boxes_in(bounds, docs)), text
    for n in ("Exchange", "Generate posexplode"):  # a term is sought without a row for each word
        assert n not in L.Near(docs, Q.leaves(Q.parse("on"))).postings()._jdf.queryExecution().executedPlan().toString()


_ODD = ["the with", "The", "THE,of", "other then", "the-with\nof", "the\n", None, "", " \n", "\u212aon \u212a\u212a kon", "\u0130t it", "éthe the\u0301", "É é", "the\u200bof", "thé", "ẞ ß", "\u212bngstr\u00d6m", "with1 1with", "𝐀the the𝐀 of", "ΤΗΟΣ σ", "x" * 300_000 + " the", "THON\u0130 thonk", "é" * 9 + " thon"]
_BAD = b"\xffthe\xff the\xc3 of\xe2\x84 thon\xff"  # not UTF-8


def _odd(spark):
    docs = spark.createDataFrame(list(enumerate(_ODD)), "doc_id LONG, text STRING")
    return docs.unionByName(spark.createDataFrame([(len(_ODD), bytearray(_BAD)), (2, bytearray(b"again with"))], "doc_id LONG, b BINARY").selectExpr("doc_id", "cast(b AS STRING) AS text"))


def test_documents_of_plain_terms_are_found_without_rows_of_tokens(spark, tmp_path):
    from pagelens.plans import catalog as C
    from pagelens.plans import layout as L

    docs = _odd(spark)
    p = L.postings(docs)
    for text in ("the", "+the -with of", "kk OR kon", "it", "é OR ß", "ångström AND NOT the", "* OR with", "the AND (of OR with)", '"the of" OR kk', "σ OR τηος", "th? AND NOT of", "don't OR of"):
        for q in (Q.parse(text), Q.parse(text, "and")):
            got = Q.documents(L.holding(docs, Q.needed(q)), Q.Bool("or", (q,)))
            assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in Q.documents(p, q).collect()), text
    held = L.holding(docs, Q.needed(Q.parse("the OR of")))
    assert held.count() == held.distinct().count() and {r.term for r in held.collect()} == {"the", "of"}
    docs.filter("text IS NOT NULL").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("q_default_and", "q_plus_minus", "q_term", "q_bool_and"):
        assert "Generate" not in C.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString(), name


def test_a_prefix_is_sought_in_texts_and_tokens_that_can_have_it(spark):
    import pyarrow as pa

    from pagelens.functions import scan
    from pagelens.plans import layout as L

    docs = _odd(spark)
    p = L.postings(docs)
    for text in ("thon*", "t?on*", "*th*", "k*", "i*", "?i*", "thoni*", "*σ", "the OR kk", "é*", "??", "ång*m"):
        q = Q.parse(text)
        rows = lambda df: sorted(map(repr, Q.matches(df, q).collect()))
        assert rows(L.Near(docs, Q.leaves(q)).postings()) == rows(p), text
    want, asked = Q.wanted(Q.leaves(Q.parse("thon*"))), []

    def noted(t):
        asked.append(t)
        return want(t)

    noted.lengths, noted.firsts, noted.sought = want.lengths, want.firsts, getattr(want, "sought", None)
    more = scan._before(noted) if hasattr(scan, "_before") else ()
    task = scan._task(noted, 1, 0, False, False, scan.PIECE, scan._letters(), *more)
    texts = ["the the tin", "thé Émile", "été thon tin Thonet"]
    out = list(task([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], ["doc_id", "text"])]))
    assert [r["doc_id"] for b in out for r in b.to_pylist()] == [3]
    assert sorted(asked) == ["thon", "thonet", "tin"]  # no token of the other texts, none that begins with another letter


def test_rows_of_words_take_no_arrays_along(spark):
    from pagelens.plans import layout as L

    rows = lambda df: sorted(map(repr, df.collect()))

    def carried(df):
        def walk(node):
            if node.nodeName() == "Generate":
                out = node.requiredChildOutput()
                yield from (out.apply(i).dataType().typeName() for i in range(out.size()))
            kids = node.children()
            for i in range(kids.size()):
                yield from walk(kids.apply(i))

        return list(walk(df._jdf.queryExecution().optimizedPlan()))

    docs = spark.createDataFrame([(1, "a b-c d " * 9), (2, ""), (3, None)], "doc_id long, text string")
    every = L.boxes(docs, counted=True, neighbours=True)
    assert "array" not in carried(every) + carried(L.postings(docs))  # each word would copy what all others have
    assert rows(L.boxes(docs, counted=True, neighbours=True, step=7)) == rows(every.filter("box_seq % 7 = 0"))


def test_snippets_are_made_once_and_unique_spans_need_no_shuffle(spark, tmp_path):
    from pagelens.plans import catalog as C

    docs = spark.createDataFrame([(1, "a on b " * 30), (2, "on of the on")], "doc_id LONG, text STRING")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("snippet_highlights_abs", "snippet_highlights_rel"):
        df = C.QUERIES[name](spark, str(tmp_path))
        assert "passage_no" not in df._jdf.queryExecution().analyzed().toString(), name  # its words are read, not made twice
        assert df.count() > 2
    for name in ("q_phrase_loose", "q_fuzzy2"):
        df = C.QUERIES[name](spark, str(tmp_path))
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString(), name
        assert df.count() == df.distinct().count()
