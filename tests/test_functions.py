"""Markup repair, parsers, analysis, options, pointers: golden vectors."""

import time

import pytest

from pagelens import options as O
from pagelens.functions.analysis import porter
from pagelens.functions.markup import boxes_to_text, detect, entities, events, parse, properties
from pagelens.functions.sanitize import sanitize
from pagelens.sources import pointer as R

SHY = "­"


def test_all_repairs_at_once():
    broken = "<b><c>h&el<»?>lo</c></b></a><a><b><c><>ser>vus&lt;<br>>welt <!,!!>dieses xml ist&;ganz schön kap<>utt<? wa<</c>"
    fixed = "<b><c>h_el_»?_lo</c></b>    <a><b><c>__ser>vus&lt;    >welt _!,!!_dieses xml ist_;ganz schön kap__utt_? wa_</c></b></a>"
    assert sanitize(broken, fix=True) == fixed


@pytest.mark.parametrize(
    ("given", "want"),
    [("", ""), ("plain & simple", "plain & simple"), ("<a><b>x</a>", "<a><b>x    </b></a>"), ("<!DOCTYPE a><p/><!DOCTYPE b><p/>", "<!DOCTYPE a><p/>            <p/>"), ("<a><!-- <b> --></a>", "<a><!-- <b> --></a>"), ("<a><![CDATA[<x>]]></a>", "<a><![CDATA[<x>]]></a>"), ("<a", "<a")],
)
def test_repairs_without_fixing(given, want):
    assert sanitize(given) == want


@pytest.mark.parametrize("s", ["<h1>x</h1>", "a &#x110000; b", "&#65; &amp; &bad", "<a><a><a", "<? no", "<<>>", "&", "<"])
def test_repair_never_moves_text(s):
    out = sanitize(s, fix=True)
    assert len(out) >= len(s) and all(a == b or b in " _" for a, b in zip(s, out))


HOCR = """<html><body><div class="ocr_page" id="page_1" title="bbox 0 0 600 800; image 'a b.png'; ppageno 0"><div class="ocr_carea"><p class="ocr_par">
<span class="ocr_line"><span class="ocrx_word" title="bbox 10 20 30 40; x_wconf 87">Grüße</span> <span class="ocrx_word" title="bbox 40 20 60 40">ver-"""


def test_hocr_words_pages_hyphens_and_alternatives():
    m = (
        '<html><body><div class="ocr_page" id="p1" title="bbox 0 0 600 800"><div class="ocr_carea"><p class="ocr_par"><span class="ocr_line">'
        '<span class="ocrx_word" title="bbox 1 2 3 4; x_wconf 87.5">Grüße</span>, <span class="ocrx_word" title="bbox 5 2 7 4">Auf' + SHY + "</span></span>"
        '<span class="ocr_line"><span class="ocrx_word" title="bbox 1 6 3 8">gabe</span> <span class="ocrx_word" title="bbox 5 6 7 8"><span class="alternatives"><ins class="alt">A&amp;B</ins><del class="alt">AB</del></span></span></span></p></div></div>'
        '<div class="ocr_page" title="bbox 0 0 1 1; x_source s7"><span class="ocr_line"><span class="ocrx_word" title="bbox 0 0 1 1">lone' + SHY + "</span></span></div></body></html>"
    )
    assert detect(m) == "hocr"
    b, pages = parse(m)
    assert [x.text for x in b] == ["Grüße", "Auf", "gabe", "A&B", "lone-"]
    assert b[0].confidence == 87.5 and (b[0].ulx, b[0].uly, b[0].lrx, b[0].lry) == (1, 2, 3, 4) and b[0].trailing == ", "
    assert (b[1].hyphen_start, b[1].dehyphenated, b[2].hyphen_start, b[4].hyphen_start) == (True, "Aufgabe", False, None)
    assert b[3].alternatives[0][0] == "AB"
    raw = m.encode()
    assert raw[b[3].text_off :].startswith(b"A&amp;B") and b[3].src_len == 7 and raw[b[3].alternatives[0][1] :].startswith(b"AB</del>")
    assert [(p.id, p.width) for p in pages] == [("p1", 600), ("s7", 1)] and [x.page_idx for x in b] == [0, 0, 0, 0, 1]
    assert boxes_to_text(b[:4]) == "Grüße, Aufgabe A&B"
    assert boxes_to_text(b[1:2]) == "Auf-"


def test_alto_spaces_hyphens_coordinates():
    m = (
        '<alto><Layout><Page ID="P1" WIDTH="10.5" HEIGHT="20"><PrintSpace><TextBlock><TextLine>'
        '<String CONTENT="one" HPOS="1.9" VPOS="2" WIDTH="3.7" HEIGHT="4" WC="0.5"><ALTERNATIVE>on</ALTERNATIVE></String><SP/><String CONTENT="hy" SUBS_TYPE="HypPart1" SUBS_CONTENT="hyphen" HPOS="5" VPOS="2"/>'
        '</TextLine><TextLine><String CONTENT="phen" SUBS_TYPE="HypPart2" SUBS_CONTENT="hyphen" HPOS="1" VPOS="8" WIDTH="2" HEIGHT="2"/><String CONTENT="x" SUBS_TYPE="HypPart1" SUBS_CONTENT="xy" HPOS="4" VPOS="8" WIDTH="1" HEIGHT="1"/></TextLine></TextBlock></PrintSpace></Page></Layout></alto>'
    )
    assert detect(m) == "alto"
    b, pages = parse(m)
    assert [x.text for x in b] == ["one", "hy-", "phen", "x-"]
    assert (b[0].ulx, b[0].lrx, b[0].lry, b[0].confidence, b[0].trailing) == (1, 4, 6, 0.5, " ") and b[0].alternatives[0][0] == "on"
    assert (b[1].lrx, b[1].trailing, b[1].hyphen_start, b[2].hyphen_start, b[2].trailing, b[3].hyphen_start) == (-1, "", True, False, "", None)
    assert (pages[0].id, pages[0].width, pages[0].height) == ("P1", 10, 20)
    assert boxes_to_text(b[:3]) == "one hyphen"


def test_namespaced_and_concatenated_documents():
    one = '<?xml version="1.0"?><!DOCTYPE a><a:alto><a:Page ID="1"><a:TextLine><a:String CONTENT="w" HPOS="1" VPOS="1" WIDTH="1" HEIGHT="1"/></a:TextLine></a:Page></a:alto>'
    b, pages = parse(sanitize(one + one))
    assert [x.text for x in b] == ["w", "w"] and len(pages) == 2


def test_miniocr():
    m = '<ocr><p xml:id="p" wh="100 200"><b><l><w x=".1 .2 .3 .4" c="9">clistrias⇿christmas⇿christrias</w> <w x="1 2 3 4">' + f"Bü{SHY}" + '</w></l><l><w x="1 2 3 4">cher</w><w x="0 0 1 1"></w></l></b></p></ocr>'
    assert detect(m) == "miniocr"
    b, pages = parse(m)
    assert [x.text for x in b] == ["clistrias", "Bü", "cher"]
    assert [a for a, _ in b[0].alternatives] == ["christmas", "christrias"] and b[0].confidence == 9
    assert all(m.encode()[o:].startswith(a.encode()) for a, o in b[0].alternatives)
    assert abs(b[0].lrx - 0.4) < 1e-6 and b[1].dehyphenated == "Bücher" and pages[0].height == 200


def test_empty_and_unknown():
    assert detect("<p>no format</p>") is None and parse("nothing") == ([], [])
    assert parse('<html><div class="ocr_page" id="page_1"></div></html>')[0] == []


def test_entities_and_properties():
    assert entities("a&shy;b&nbsp;c&#65;&#x42;&unknown;&amp;") == f"a{SHY}b\xa0cAB&amp;unknown;&"
    assert properties("bbox 1 2 3 4; image \"x.png\"; x_source 'a b'") == {"bbox": "1 2 3 4", "image": "x.png", "x_source": "a b"}


@pytest.mark.parametrize(("w", "s"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("relational", "relat"), ("electricity", "electr"), ("adjustable", "adjust"), ("sky", "sky"), ("by", "by")])
def test_stems(w, s):
    assert porter(w) == s


@pytest.mark.parametrize("p", ["a", "a[1:2]", "a[1:]+b[:9]", "a{ascii}[1:2,5:9]+b", "/x/y z.xml[:4,7:]"])
def test_pointers_round_trip(p):
    assert R.is_pointer(p) and R.render(R.parse(p)) == p


def test_pointer_regions_are_sorted_and_checked():
    assert str(R.parse("f[9:12,1:3]")[0]) == "f[1:3,9:12]"
    for bad in ("<ocr/>", "a[x:y]", "a[1", "", "a++b"):
        assert not R.is_pointer(bad)
    with pytest.raises(R.PointerError):
        R.parse("a[5:3]")


def test_utf8_trimming():
    raw = "aé日😀z".encode()
    for i in range(len(raw) + 1):
        for j in range(i, len(raw) + 1):
            text = R.trim_utf8(raw[i:j]).decode()  # never half a character
            assert text in "aé日😀z"


def test_options():
    o = O.resolve({"hl.snippets": "3", "hl.ocr.contextSize": "5", "f.x.hl.ocr.contextSize": "7", "hl.ocr.absoluteHighlights": "on"}, "x")
    assert (o.snippets, o.context_size, o.absolute_highlights, o.passage_limit) == (3, 7, True, 100)
    assert O.resolve({"f.x.hl.ocr.contextSize": "7"}, "y").context_size == 2
    assert O.enabled({"hl": "true"}) and not O.enabled({"hl": "true", "hl.ocr": "false"})
    assert O.HighlightOptions().limit_levels() == ("block", "section", "page") and O.HighlightOptions(limit_block="none").limit_levels() == ()
    assert O.fields("ocr_* title", ["title", "ocr_a", "ocr_b", "text"]) == ["ocr_a", "ocr_b", "title"]
    assert O.regular_fields(["title", "ocr_a"], ["ocr_a"]) == ["title"]


@pytest.mark.parametrize("bad", ["<a", "<a ", '<a "', "<a '", '<a b="', "<!--", "<![CDATA[", "<!", "<?", "<b>", "</i>", "&", "<", "&#", "<a \">"])
@pytest.mark.parametrize("tail", ["", ">", "<w x='1 1 1 1'>q</w>"])
def test_bad_markup_takes_linear_time(bad, tail):
    markup = bad * (100_000 // len(bad)) + tail
    began = time.process_time()
    list(events(markup))
    sanitize(markup)
    sanitize(markup, fix=True)
    assert time.process_time() - began < 2


@pytest.mark.parametrize(
    ("markup", "texts"),
    [("<a>x<!-- y > z", ["x"]), ("<a>x<!-- y z", ["x"]), ("<a>x<![CDATA[ y > z", ["x", " y > z"]), ("<a>x<![CDATA[ y z", ["x", " y z"]), ("<a>x</a> tail <b", ["x", " tail <b"]), ("<a>x<!-- c -->t", ["x", "t"])],
)
def test_what_never_ends_goes_on_to_the_end(markup, texts):
    assert [e.text for e in events(markup) if e.kind == "text"] == texts


def test_documents_of_one_shape_are_read_as_the_parser_reads_them():
    import pyarrow as pa

    from pagelens.functions import markup, shapes
    from pagelens.operators import boxes as B

    page = '<div class="ocr_page" id="p{0}" title="bbox 0 0 {0} 9"><div class="ocr_carea"><span class="ocr_line">{1}</span></div></div>'
    word = '<span class="ocrx_word" title="bbox {} 2 3 4{}">{}</span>'
    hocr = "<html>" + "".join(page.format(k, word.format(k, "; x_wconf 9", "é&amp;b") + ", x " + word.format(1, "", "don't")) for k in (1, 2)) + "</html>"
    alto = '<alto><Page ID="a&amp;b" WIDTH="1" HEIGHT="2"><TextLine>' + "".join(f'<String HPOS="{k}" VPOS="1" WIDTH="1" HEIGHT="2" CONTENT="w{k}ü" WC="0.{k}"/>' + "<SP/>" * (k % 3) for k in range(9)) + "</TextLine></Page></alto>"
    mini = '<ocr><p xml:id="p" wh="1 2"><b><l><w x="1 2 3 4">a</w> <w x=".1 .2 .3 .4" c="9">b</w></l><l><w x="1 2 3 4">&lt;</w></l></b></p></ocr>'

    def read(text):
        name = markup.detect(text)
        r = shapes.Reader(next(f.handler for f in markup.FORMATS if f.name == name))
        return r.words(B._ARROW)[1].to_pylist() if r.begin() or r.add(text) else None

    def parsed(text):
        out = [[] for _ in B._ARROW]
        B._columns(text, False, tuple(markup.FORMATS), out)
        return pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(out, B._ARROW)], fields=list(B._ARROW)).to_pylist()

    for text in (hocr, alto, mini):
        assert read(text) == parsed(text) and len(parsed(text)) > 2
    for text in (hocr.replace("don't", f"do{SHY}"), hocr.replace("</div>", "", 1), hocr.replace(", x", ", <br>"), hocr.replace("don't", "<b>x</b>"), alto.replace("w3", "w&#173;"), alto.replace("/><SP/>", "><ALTERNATIVE>v</ALTERNATIVE></String>", 1), mini.replace("a<", "a⇿b<"), mini.replace(' x="1 2 3 4">a', ">a"), mini.replace("<b>", "<!-- <b>")):
        assert read(text) is None, text  # the parser's


def test_plain_documents_beside_others_keep_their_order(spark):
    from pagelens.operators import boxes as B

    texts = ['<w x="1 2 3 4">a</w> <w x="1 2 3 4">b</w>', None, "no markup", '<w x="1 2 3 4">c⇿d</w>', '<alto><String HPOS="1" VPOS="1" WIDTH="1" HEIGHT="1" CONTENT="e"/></alto>', "", '<w x="1 2 3 4">f</w>']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, markup STRING").coalesce(1)
    got = B.parsed(docs).selectExpr("doc_id", "boxes.text AS t", "error").orderBy("doc_id").collect()
    assert [r.t for r in got] == [["a", "b"], [], [], ["c"], ["e"], [], ["f"]]
    assert [r.error for r in got] == [None, None, "unknown format", None, None, None, None]
