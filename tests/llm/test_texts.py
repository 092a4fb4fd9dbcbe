"""Tokenizing, packing, URL rules, archives, extraction, learned filters and the pipeline."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_pairs import corpus
from viaduct.llm import bpe, html_extract, langid, packing, queries, toxicity, url_filter, warc

MEDIUM, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
TEXTS = [*corpus()[-12:], "a  b\n\n c\t\td \u00a0\u3000 e", "<|endoftext|> in <|endoftext|>text", "don't I'LL we've 123 4567 ++ é漢字 😀\r\n", " lead", "trail ", "\x00\x1c\x85\u2028x", "ab" * 5000]
DOCS = "doc_id long, text string, id string, ids string, n_tokens string, score string, lang_pred string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "c", None, None, "c", "c") for k, t in enumerate(TEXTS)] + [(None, "no id", None, None, None, None, None), (0, TEXTS[0], None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


def packed(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_bpe_equals_library(spark, docs, library):
    got = bpe.encode_digests(docs, queries.tokenizer_path())
    seen = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect() if r.doc_id is not None}
    assert got.count() == len(TEXTS) + 2
    for k, t in enumerate(TEXTS):
        ids = packed(library, t)
        decoded = library.decode(ids.tolist(), skip_special_tokens=False)
        assert seen[k] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()), repr(t)[:60]
    assert bpe.encode_digests(docs.limit(0), queries.tokenizer_path()).isEmpty()


def test_bpe_of_real_documents(spark, library):
    rows = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.ids_sha256 for r in queries.op4_bpe(spark, MEDIUM).collect()}
    assert got == {r.doc_id: hashlib.sha256(packed(library, r.text).tobytes()).hexdigest() for r in rows}


def check_packing(pieces, want, limit=1024):
    """Every id lies in one piece, sequences are gapless and little is padded."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for key, ids in want.items():
        at = 0
        for p in sorted(by_doc[key], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padded = 0
    for rows in by_sequence.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limit
        padded += 0 if at & (at - 1) == 0 else limit - at
    assert padded <= 0.01 * sum(map(len, want.values()))


def test_packing(spark, docs, library):
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want = {k: np.append(packed(library, t), np.uint32(0)).astype("<u4") for k, t in enumerate(TEXTS)}
    check_packing(packing.pack(unique, queries.tokenizer_path()).collect(), want)
    assert packing.pack(docs.limit(0), queries.tokenizer_path()).isEmpty()
    assert packing.pack(docs, queries.tokenizer_path()).where("doc_id IS NULL").count() == 1


def test_packing_keeps_all_limits(spark):
    packer = packing.Packer(100, 4, 60)
    rng = np.random.default_rng(1)
    size = rng.integers(1, 150, 300)
    prompt = (size * rng.random(300)).astype(np.int64)
    seen = [np.zeros(n, int) for n in size]
    for sequence in packer.fill(size, prompt, True):
        assert len(sequence) <= 4 and sum(n for *_, n in sequence) <= 100
        assert sum(max(0, s + n - max(s, prompt[k])) for k, s, n in sequence) <= 60
        for k, s, n in sequence:
            seen[k][s : s + n] += 1
    assert all((x == 1).all() for x in seen)


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, "allow")


def test_url_rules_equal_brute_force(spark):
    hosts = ["example.org", "EXAMPLE.org", "a.example.org", "xexample.org", "org", "com", "x.com", "", ".", "org.com", "user@example.org", "example.org:80", "a..org", "ÉX.org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x#y", "/fr/a", "/de/#x", "?q=/de/", "#/fr/", "//es/", "/ES/"]
    urls = [f"{s}{h}{p}" for s in ("http://", "://", "x://y://", "") for h in hosts for p in paths] + [None, "", "nothing", "http://" + "a." * 3000 + "org/x"]
    pages = spark.createDataFrame([(k, u, "c", 3, "x") for k, u in enumerate(urls)] * 2, "page_id long, url string, host string, key int, row string")
    got = url_filter.judge(pages, url_filter.rules_table(spark, queries.URL_RULES))
    assert got.count() == 2 * len(urls)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {k: brute_rule(u) for k, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0), url_filter.rules_table(spark, [])).isEmpty()
    plan = got._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_nested_rules_of_one_host_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("ab/"), rng.integers(0, n)))
    rules = sorted({(h, "/" + word(6)) for _ in range(300) for h in ("a.org", "org", "b.a.org")})
    rules = [(h, p, "block" if k % 3 else "allow") for k, (h, p) in enumerate(rules)]
    urls = [f"http://{h}/{word(9)}" for _ in range(1200) for h in ("a.org", "x.b.a.org", "c.org", "com")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = {}
    for k, u in enumerate(urls):
        host, path = u[7:].split("/", 1)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        want[k] = max(fits)[2:] if fits else (None, "allow")
    got = url_filter.judge(pages, url_filter.rules_table(spark, rules))
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == want


def test_archives_round_trip(spark):
    html = ["<p>é</p>", "same", "same", None, "", "WARC/1.1\r\n\r\nWARC/1.0\r\n\r\n\r\n", "x" * 300_000, "same"]
    pages = spark.createDataFrame([(k, "http://h/\r\nq" if k % 2 else None, h, "c", "s") for k, h in enumerate(html)] + [(None, "u", "same", None, None), (1, "u", "same", None, None)], "page_id long, url string, html string, digest string, seed string")
    got = warc.archive_round_trip(pages)
    seen = sorted(got.collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.payload_bytes))
    assert len(seen) == len(html) + 2
    for r in seen:
        raw = ("same" if r.page_id is None else html[r.page_id] or "").encode()
        peers = [k for k, h in enumerate(html) if (h or "").encode() == raw]
        revisit = r.page_id is not None and r.page_id < max(peers)
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.record_type, r.refers_to) == (("revisit", max(peers)) if revisit else ("response", None))
        assert bytes(r.capture.payload) == (b"" if revisit else raw) and r.capture.request.startswith("GET ")
        assert r.intact
    assert warc.archive_round_trip(pages.limit(0)).isEmpty()
    short = sorted(tuple(r) for r in warc.archive_round_trip(pages.where("page_id IS NOT NULL"), payloads=False).collect())
    assert short == sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, True) for r in seen if r.page_id is not None)


def test_many_repeated_payloads_are_joined(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_OWNERS", 0)
    pages = spark.createDataFrame([(k, "u", f"page {k % 3}") for k in range(30)] + [(5, "u", "page 2")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.refers_to) for r in warc.archive_round_trip(pages, payloads=False).collect())
    assert got == sorted([(k, 27 + k % 3 if k < 27 else None) for k in range(30)] + [(5, 29)], key=str) or got == sorted([(k, 27 + k % 3) for k in range(27)] + [(5, 29)]) + [(27, None), (28, None), (29, None)]


def record(kind, name, block, *fields):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *fields, f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_foreign_archives_with_long_heads_and_damage(spark, tmp_path):
    http, digest = "Content-Type: application/http; msgtype=response", lambda raw: f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(raw).digest()).decode()}"
    head = b"HTTP/1.1 200 OK\r\nX: " + b"y" * 10_000 + b"\r\n\r\n"
    raw = b"a\r\n\r\nb"
    parts = [record("warcinfo", "<i>", b"x"), record("response", "<a>", head + raw, http, digest(raw)), record("response", "<b>", head + b"hurt", http, digest(b"whole"))]
    parts += [record("revisit", "<c>", head, http, digest(raw), "WARC-Refers-To: <a>"), record("revisit", "<d>", head, http, digest(b"whole"), "WARC-Refers-To: <b>"), record("revisit", "<e>", head, http, digest(raw), "WARC-Refers-To: <lost>")]
    parts += [record("request", "<r>", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Concurrent-To: <a>"), record("metadata", "<m>", b"page-id: 7\r\n", "WARC-Concurrent-To: <a>")]
    (tmp_path / "part-0.warc").write_bytes(b"".join(parts))
    found = warc.transactions(warc.measured(warc.read_archives(spark, str(tmp_path))))
    payload = {r.record_id: bytes(r.payload) for r in found.collect()}
    assert payload == {"<a>": raw, "<b>": b"hurt", "<c>": b"", "<d>": b"", "<e>": b""}
    got = {r.capture.record_id: (r.page_id, r.payload_bytes, r.refers_to, r.intact) for r in warc.resolved(found).collect()}
    assert got == {"<a>": (7, len(raw), None, True), "<b>": (None, 4, None, False), "<c>": (None, len(raw), 7, True), "<d>": (None, 4, None, False), "<e>": (None, None, None, False)}


def test_no_query_changes_the_session(spark):
    before = dict(spark.conf.getAll)
    for name in ("op2_simhash", "op4_bpe", "op5_url_filter", "op7_packing", "op8_html", "op9_langid", "op10_warc"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()
        assert dict(spark.conf.getAll) == before, name


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site &amp; more</header><nav><a href=x>Menu</a></nav>
<div class="cookie-notice">We use cookies, please agree.</div><div id=content><h1>A  title</h1><p>First   paragraph, with &eacute; and <b>bold</b> words, enough of them, to count.</p>
<script>var x = "<p>no</p>";</script><p>Second &lt;paragraph&gt;, also long enough, with commas, and more.</p></div><div class="comments"><p>Nice, post, really, I like, it.</p></div><footer>Imprint</footer></body></html>"""


ARTICLE = "<h1>A title</h1><p>First paragraph, with words, enough of them, to count.</p><p>Second one, also long, with commas, and more.</p>"
BODY = "A title\n\nFirst paragraph, with words, enough of them, to count.\n\nSecond one, also long, with commas, and more."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article class="post has-sidebar">{ARTICLE}</article><footer>x</footer>', BODY),
        (f'<article class="sidebar">{ARTICLE}</article>', BODY),
        (f'<div class="content with-comments">{ARTICLE}<div class="comments"><p>I, too.</p></div></div><div>Imprint</div>', BODY),
        (f'<div><p class=x">A stray, quote, here.</p>{ARTICLE}</div>', "A stray, quote, here.\n\n" + BODY),
        (f'<div>{ARTICLE}<p>some <span hidden>no</span>text <span class="ad">buy <span>it</span> now</span> goes on</p></div>', BODY + "\n\nsome text goes on"),
        (f"<body><div>{ARTICLE}</div><ul><li>one</li><li>two</li></ul><table><tr><td>cell</td></tr></table></body>", BODY + "\n\none\n\ntwo\n\ncell"),
        (f'<div class="page-header sidebar-layout"><article>{ARTICLE}</article></div>', BODY),
        (f'<div id="c">{ARTICLE}</div><div class="comments">{5 * ARTICLE}</div>', BODY),
        (f"<body>{ARTICLE}<!-- <p>no</p> --><!--><p>yes, this, too</p></body>", BODY + "\n\nyes, this, too"),
        (f"<main><div class='related'><ul><li><a href=x>other</a></li></ul></div>{ARTICLE}</main>", BODY),
        ("<div>" + f"<p>{'word, ' * 40}</p>" * 5000 + "</div>", "\n\n".join([("word, " * 40).strip()] * 5000)),
    ],
)
def test_pages_of_many_makes(page, want):
    assert html_extract.main_text(page) == want


PROSE = "<p>A paragraph of the article, with commas, and some words.</p>"
TOLD = "A paragraph of the article, with commas, and some words."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><h1>T</h1>{PROSE}<div class='discussion'><p>What the results mean, in short.</p></div></article>", ["T", TOLD, "What the results mean, in short."]),
        (f"<article>{PROSE}<h2 id='discussion'>Discussion</h2>{PROSE}<section id='responses'><p>Few answered.</p></section></article>", [TOLD, "Discussion", TOLD, "Few answered."]),
        (f"<article>{PROSE}<p class='notice'>Take note.</p><p id='search-results'>Found.</p><pre class='form'>x = 1</pre></article>", [TOLD, "Take note.", "Found.", "x = 1"]),
        (f"<div class=hd><h1>Head</h1></div><div>{PROSE * 4}</div>", ["Head", *[TOLD] * 4]),
        (f"<div>{PROSE * 4}</div><div><h2>Part two</h2><p>one, small.</p></div><div>{PROSE * 4}</div>", [*[TOLD] * 4, "Part two", "one, small.", *[TOLD] * 4]),
        ("<article><p>one <label>two</label> three</p></article>", ["one two three"]),
        (f"<article>{PROSE}<div class='discussion'><ul><li><b class=author>Bo</b> Nice, really.</li><li><b class=author>Al</b> No.</li></ul></div><div class='comments'><p>Mine, too.</p></div></article>", [TOLD]),
        (f"<article>{PROSE}<div class='notice'><p>We use cookies.</p></div><div class='search-form'>Find</div><p class='advert'>Buy, now.</p><div class='tags'><a href=x>one</a> <a href=y>two</a></div></article>", [TOLD]),
    ],
)
def test_names_weigh_inside_an_article(page, want):
    assert html_extract.main_text(page).split("\n\n") == want


def test_articles_of_a_grammar():
    """Pages put together from parts of which it is known whether they belong to the article."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    sentence = lambda n: ", ".join(" ".join(word() for _ in range(4)) for _ in range(n)) + "."
    link = lambda: f"<li><a href='/{word()}'>{word()}</a></li>"
    beside = [
        lambda: f"<nav><ul>{link() * 5}</ul></nav>", lambda: f"<div class='{rng.choice(['ad', 'sidebar', 'cookie-banner', 'related-posts', 'newsletter'])}'><p>{sentence(2)}</p></div>", lambda: f"<footer><p>{sentence(1)}</p></footer>",
        lambda: f"<aside><p>{sentence(2)}</p></aside>", lambda: f"<form><label>{word()}</label><input></form>", lambda: f"<script>{sentence(1)}</script><style>p {{}}</style>", lambda: f"<section class='comments'><p>{sentence(2)}</p></section>",
    ]
    for _ in range(60):
        parts, want = [], []
        for _ in range(rng.integers(2, 9)):
            text = sentence(int(rng.integers(1, 6)))
            tag = rng.choice(["p", "p", "p", "h2", "blockquote", "pre"])
            name = rng.choice(["", " class='lead'", " id='discussion'", " class='notice'"])
            shown = text.replace(" ", " <em>", 1).replace(",", "</em>,", 1) if rng.random() < 0.5 and "," in text else text
            parts.append(f"<{tag}{name}>{shown}</{tag}>" if rng.random() < 0.8 else f"<div id='responses'><p>{shown}</p></div>")
            want.append(text)
            if rng.random() < 0.3:
                parts.append(beside[rng.integers(len(beside))]())
        around = [beside[k]() for k in rng.integers(0, len(beside), 4)]
        page = f"<html><head><title>{word()}</title></head><body>{''.join(around[:2])}<article><h1>{(head := word())}</h1>{''.join(parts)}</article>{''.join(around[2:])}</body></html>"
        assert html_extract.main_text(page).split("\n\n") == [head, *want]


def test_numbers_are_no_letters():
    assert [langid.has_letter(t) for t in ("½ ²", "Ⅷ ① ٣", "1_2", "", "½a", "ª", "漢", "ʰ")] == [False, False, False, False, True, True, True, True]


def test_extraction(spark):
    want = "A title\n\nFirst paragraph, with é and bold words, enough of them, to count.\n\nSecond <paragraph>, also long enough, with commas, and more."
    odd = [None, "", "   ", "<", "<p", "&", "plain text", "<div>" * 3000, "<!-- open", "<script>x"]
    pages = spark.createDataFrame([(0, "u", PAGE, "t", 1)] + [(k + 1, None, h, None, None) for k, h in enumerate(odd)] + [(None, None, PAGE, None, None)], "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract(pages).collect()
    assert len(got) == len(odd) + 2 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (0, None)} == {want}
    assert {r.page_id: r.text for r in got if r.page_id in (1, 2, 3)} == {1: "", 2: "", 3: ""}
    assert html_extract.extract(pages.limit(0)).isEmpty()


def test_language_of_held_out_documents(spark, docs):
    got = queries.op9_langid(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) > 100
    real = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = langid.fit(real)
    odd = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(odd[k].lang_pred == "und" for k, t in enumerate(TEXTS) if not any(c.isalpha() for c in t or ""))
    assert langid.identify(docs.limit(0), model).isEmpty()
    nothing = langid.fit(real.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing, into="score_").select("score_.*").collect()} == {"und"}


def test_texts_in_slices_are_what_they_are_whole(monkeypatch, library):
    texts = [t for t in TEXTS if t and len(t) < 5000]
    with open(queries.tokenizer_path(), "rb") as f:
        enc = bpe.Encoder(f.read(), bpe.Transducer.build([]))
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b"], langid.codewords(2), rng.random((1 << langid.BUCKET_BITS, 1)), np.ones(1), np.ones(1))
    margins = [model.margins(t.encode()).tolist() for t in texts]
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(bpe, "SLICE_CHARS", size)
        monkeypatch.setattr(bpe.slices, "__defaults__", (size,))
        assert [list(np.frombuffer(x, "<u4")) for x in enc.encode(texts)] == [packed(library, t).tolist() for t in texts]
        monkeypatch.setattr(langid, "SLICE_BYTES", size)
        for t, m in zip(texts, margins, strict=True):
            np.testing.assert_allclose(model.margins(t.encode()), m)


def test_decoding_takes_the_codeword_of_least_loss():
    rng = np.random.default_rng(2)
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, rng.standard_normal((1 << langid.BUCKET_BITS, code.shape[1])), rng.random(code.shape[1]) + 0.5, rng.random(code.shape[1]) + 0.1)
    for text in ("some text", "zwölf", "x", "Abc def " * 50):
        raw = b" " + bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()) + b" "
        bucket = lambda g: ((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 % 2**32) >> (32 - langid.BUCKET_BITS)
        z = np.mean([model.weights[bucket(raw[k : k + 3])] for k in range(len(raw) - 2)], axis=0) / model.scale
        loss = [sum(t * np.log1p(np.exp(-4 * c * m)) for c, m, t in zip(word, z, model.trust, strict=True)) for word in code]
        assert model.predict(text)[0] == "abcd"[int(np.argmin(loss))]


def test_lexicon_matches_equal_brute_force():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 7))) for _ in range(60)]
    weights = {w: float(k + 1) for k, w in enumerate(dict.fromkeys(words[:25]))}
    exceptions = [f"{a} {b}" for a, b in zip(words[20:30], words[30:40], strict=True)]
    model = toxicity.Model(weights, exceptions)
    for _ in range(200):
        line = [words[k] for k in rng.integers(0, 60, 30)]
        folded = toxicity.fold(" ".join(line))
        excused = {k for k in range(29) if f"{line[k]} {line[k + 1]}" in exceptions}
        want = 0.0
        for k, w in enumerate(line):
            fits = [p for p in weights if (w == p if len(p) < toxicity.BEGINNING[0] else w.startswith(p))]
            if fits and k not in excused and k - 1 not in excused:
                want += weights[max(fits, key=len)]
        assert sum(w for *_, w in model.matches(folded)) == want


def test_codewords_are_apart():
    for n in (2, 4, 6, 9, 40):
        code = langid.codewords(n)
        assert min(int((code[a] != code[b]).sum()) for a in range(n) for b in range(a)) >= 1


def test_toxicity_of_held_out_documents(spark, docs):
    got = queries.op6_toxicity(spark, LARGE).join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    hits = sum(r.predicted and r.toxic for r in got)
    assert hits >= 0.85 * sum(r.toxic for r in got) and hits >= 0.95 * sum(r.predicted for r in got)
    model = toxicity.Model({"nast": 3.0}, ["nasty weather"], 4.0, -4.0)
    assert model.score("you n4sty thing") > 0.5
    assert model.score("you nаsty thing") > 0.5 > model.score("nasty weather today")
    assert model.score(None) == model.score("") < 0.5 and model.score("dynasty") < 0.5
    out = toxicity.score(docs, model, into="verdict")
    assert out.count() == len(TEXTS) + 2 and out.columns == [*docs.columns, "verdict"] and out.schema["verdict"].dataType.names == ["score", "predicted"]
    assert toxicity.score(docs.limit(0), model).isEmpty()
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).score("anything") < 0.5


def test_pipeline_stages(spark, library, tmp_path):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        stage(spark, docs, MEDIUM).write.parquet(f"{tmp_path}/{k}")
        docs, last = spark.read.parquet(f"{tmp_path}/{k}"), docs
        if name != "packing":
            assert docs.columns == columns and 0.5 * before < docs.count() <= before
    want = {r.doc_id: np.append(packed(library, r.text), np.uint32(0)).astype("<u4") for r in last.collect()}
    check_packing(docs.collect(), want)


def test_stages_account_for_every_row(spark, tmp_path):
    """Null and repeated ids, and columns named like those of the stages."""
    real = [r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").where("lang IS NOT NULL").orderBy("doc_id").limit(400).collect()]
    rows = [(None if k % 50 == 0 else k // 2, t, "en", "s", len(t), -1.0, "mine", True, "k") for k, t in enumerate(real)] + [(None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score double, lang_pred string, ambiguous boolean, doc_key string")
    model = langid.fit(docs.where(corpus_pipeline.remainder(4) != 2))
    verdicts = [model.predict(t) for t in (r[1] for r in rows)]
    want = sorted(str(r) for r, (lang, _, doubt) in zip(rows, verdicts, strict=True) if lang != "und" and not doubt)
    kept = corpus_pipeline.language(spark, docs, MEDIUM)
    assert sorted(str(tuple(r)) for r in kept.collect()) == want
    clean = corpus_pipeline.toxic(spark, docs, MEDIUM)
    assert clean.columns == docs.columns and clean.where("score = -1 AND lang_pred = 'mine'").count() >= 0.8 * len(real)
    one = corpus_pipeline.near_dedup(spark, docs, MEDIUM)
    assert one.columns == docs.columns and one.where("doc_key = 'k'").count() + 1 == one.count()


def test_empty_corpus(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{MEDIUM}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_toxicity_sample_ignores_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, "one bad text", 7, 8, 9), (2, "two fine texts", 7, 8, 9)], "doc_id long, text string, y int, picked int, doc int")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert sorted((r.text, r.y) for r in toxicity.sample_rows(docs, labels).collect()) == [("one bad text", 1), ("two fine texts", 0)]


def test_sequences_closed_by_segments_need_no_padding(spark):
    tiny = spark.createDataFrame([(k, "a b c d") for k in range(2000)], "doc_id long, text string").coalesce(1)
    lengths = {}
    for r in packing.pack(tiny, queries.tokenizer_path()).collect():
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert all(n & (n - 1) == 0 and n <= 1024 for n in lengths.values())
