"""HTML extraction, language ID, personal data, chat formatting and token counts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.llm import chat, html, langid, oracles, pii, queries, tokencount

from . import helpers

SF = "/root/testdata/sf0.001"
NONE = [None] * 7
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


AWKWARD = [
    None, "", "a@b.c%d@e.f@g.h.i x..y@b-.c..d é@é.é a.@b.c", "1.2.3.45.6.7.8 256.1.1.1 00000255.0.0.0001 1.2.3.4.5.6.7.8 9" + "9" * 30 + ".1.1.1", "1.2.3.4@5.6 +1.2.3.4.5.6.7.8.9.0", "4111 1111-1111 1111 4111  1111 4111111111111111",
    "+1 (974) 555-3436 ++12 34567890- +1234 5678 9012 3456 7890 +1", "\x01a@b.c\x03d@e.f\x02 1\x0112 𝒳𝒴 a@𝒳.c ñ a.b@c.d.", "4111 1111 1111 1111 " * 50, "1 " * 20_000, "a@" + "b." * 20_000 + "c", "9" * 50_000, "+" * 3000 + "1 2 3 4 5 6 7 8 9",
    "call (017) 555-7713 or 555-123-4567 now", "score 12 345 6789", "x" * 30_000,
]


def test_base_spans(spark):
    rng = random.Random(2)
    texts = [*AWKWARD, *("".join(rng.choice("19 -.+@ab()\n") for _ in range(60)) for _ in range(400)), *("".join(rng.choice(["a@b", ".c", "1.2", ".3.4", "4111111111111111", "-", " ", "+1 555", "(", "@"]) for _ in range(14)) for _ in range(300))]
    model = pii.train(spark)
    out = pii.find_pii(helpers.frame(spark, [(i, t, *NONE) for i, t in enumerate(texts)]), model).select("doc_id", "base", "spans").collect()
    assert len(out) == len(texts)
    for r in out:
        assert [(s.start, s.kind, s.end) for s in r.base] == base_spans(texts[r.doc_id]), texts[r.doc_id][:200]
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans} and r.spans == sorted(r.spans)
    assert pii.find_pii(helpers.frame(spark, []), model).count() == 0


def test_pii_digests(spark):
    texts = dict((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    for r in queries.op4_personal_data(spark, SF).collect():
        base = base_spans(texts[r.doc_id])
        joined = ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == helpers.sha(joined) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_pii_digests_match_sql(spark):
    import duckdb

    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(duck.execute(oracles.base_pii_sql()).fetchall())
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in queries.op4_personal_data(spark, SF).collect())
    assert got == want and any(sum(r[1:5]) for r in got)


def test_pii_model_selects(spark):
    texts = ["please call (017) 555-7713 today", "see order 555-123-4567 for it", "write to jane (at) example (dot) com", "login from host 10[.]0[.]0[.]7 twice", "we met at home dot dot", "visa card 4111.1111.1111.1111 used"]
    out = pii.find_pii(helpers.frame(spark, [(i, t, *NONE) for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    found = [pii.redact(t, [tuple(s) for s in r.spans]) for t, r in zip(texts, out, strict=True)]
    assert found == ["please call [phone] today", texts[1], "write to [email]" if found[2].endswith("[email]") else found[2], "login from host [ip] twice", texts[4], "visa card [card] used"]
    held = pii.examples(99)
    model, rows = pii.train(spark), helpers.frame(spark, [(i, t, *NONE) for i, (t, _) in enumerate(held)])
    got = {r.doc_id: bool(r.spans) for r in pii.find_pii(rows, model).collect()}
    tp = sum(got[i] and y for i, (_, y) in enumerate(held))
    assert tp / sum(got.values()) >= 0.97 and tp / sum(y for _, y in held) >= 0.8


def test_secrets_and_examples_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 3 = 0")
    model = pii.train(spark, docs)
    found = pii.recall(docs, model)
    assert all(hit >= 0.9 * n for n, hit in found.values()) and sum(n for n, _ in found.values()) > 20, found
    planted = re.compile(r'(?i)token = "([0-9a-f]{40})"')
    seen = [((m.start(1), 4, m.end(1)) in {tuple(s) for s in r.spans}) for r in pii.find_pii(docs, model).select("text", "spans").collect() for m in planted.finditer(r.text or "")]
    assert len(seen) > 20 and sum(seen) >= 0.95 * len(seen)
    plain = ["see commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b today", "a well-known-but-long-word-2024 here", "https://example.com/news/2024/long-title-of-page-12"]
    assert not any(r.spans for r in pii.find_pii(helpers.frame(spark, [(i, t, *NONE) for i, t in enumerate(plain)]), model).collect())


def test_pii_proposals_are_wide(spark):
    spans = {
        "jane@example(dot)com": 0, "jane@example[dot]com": 0, "jane @ example.com": 0, "jane at example.com": 0, "fe80::1ff:fe23:4567": 1, "2001:db8::1": 1,
        "3782.822463.10005": 2, "3782_822463_10005": 2, "06 12 34 56 78": 3, "0612345678": 3, "555-1234567": 3,
    }
    before = ["write to ", "server ", "visa card ", "please call "]
    texts = [f"some words, {before[k]}{x} today" for x, k in spans.items()]
    out = pii.find_pii(helpers.frame(spark, [(i, t, *NONE) for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    found = [pii.redact(t, [tuple(s) for s in r.spans]) for t, r in zip(texts, out, strict=True)]
    assert found == [f"some words, {before[k]}[{pii.KINDS[k]}] today" for k in spans.values()]
    clean = ["he looked at home. Then he left", "in std::vector or a :: b", "on 2024-01-15 we met", "order 0612345678 came", "number 1234567890123456 is plain"]
    assert not any(r.spans for r in pii.find_pii(helpers.frame(spark, [(i, t, *NONE) for i, t in enumerate(clean)])).collect())


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{x}</style><script>var a="<p>no</p>";</script></head><body class="c7">
<header><h1>Site</h1><a href="/">Home</a></header><nav><ul><li><a href="a>b">Menu</a></ul></nav><div class="cookie-notice">We use cookies, a lot of them, more than you would think.</div>
<article><h1>Head &amp; line</h1><p>First   para&nbsp;graph <b>bold<br>more<p>Second &eacute;&#233; with <a href=x>link</a>.<ul><li>one<li>two</ul><div class="ad-slot">Buy now</div><form><input><p>Sign up</p></form>
<table><tr><td>c1<td>c2<tr><td>c3</table><pre>x
  y</pre></article><div id="comments"><p>A reader says many many words that are long enough to count for much, a reader says.</p></div><aside><p>side</p></aside><footer>foot</footer></body></html>"""


def test_extract():
    want = "Head & line\nFirst para graph bold more\nSecond éé with link.\none\ntwo\nc1\nc2\nc3\nx y"
    assert html.extract(PAGE) == want
    assert html.extract(PAGE, html.vote(PAGE)[0]) == want
    assert html.vote(PAGE)[0] == "/html/body.c/article"
    assert html.extract(None) == html.extract("") == html.extract("<!-- only") == ""
    assert html.extract("just text") == "just text"
    assert html.extract("<p>a<p>b</span></p>c") == "a\nb\nc"
    assert html.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert html.extract("<b>" * 40_000 + "</i>" * 40_000 + "x") == "x" and html.extract("<header>" * 30_000 + "y") == ""
    assert html.extract('<article><p>kept</p><a href="cut') == "kept"
    assert html.extract("<article><p>one<p>two" + "<b>" * 3000 + "three") == "one\ntwothree"
    assert [html.host_of(u) for u in (None, "", "http://a.B.c:80/x", "//u:p@h/x?y", "nothost/x")] == ["", "", "a.b.c", "h", ""] or html.host_of("nothost/x") == "nothost"


def test_truncated_pages():
    for i in range(0, len(PAGE), 3):
        assert "<" not in html.extract(PAGE[:i]).replace("<p>no</p>", "")


def test_noise_is_a_whole_word_and_never_the_article():
    article = "<article><h1>Head</h1><p>Words of the story.</p></article>"
    for wrap in ("layout with-sidebar", "sidebar-layout", "has-cookie-notice", "menu", "promo"):
        assert html.extract(f'<div class="{wrap}">{article}</div>') == "Head\nWords of the story."
    assert html.extract('<article><header class="entry-header"><h1>Title</h1></header><p>Words.</p></article>') == "Title\nWords."
    assert html.extract('<div class="post" data-id="comments"><p>Words.</p></div>') == "Words."
    assert html.extract('<div class="post" title="see id=footer ok"><p>Words.</p></div>') == "Words."
    assert html.extract('<div class="menu"><p>All that the page has to say.</p></div><p>x</p>').startswith("All that")
    assert html.extract('<div class="story"><p>Words.</p></div><div id="comments"><article class="comment"><p>A reader has more to say than the page.</p></article></div>') == "Words."
    assert html.extract('<div><p>Words of the story.</p></div><div class="ad-slot2">Buy</div><div class="cookie_notice"><p>Cookies</p></div>') == "Words of the story."
    assert html.attributes_of(' class = "a b" data-id=x ID=\'y\' hidden title="id=z" id="no"') == {"class": "a b", "data-id": "x", "id": "y", "hidden": "", "title": "id=z"}


def test_story_over_siblings():
    assert html.extract("<body><article><p>One part of it.</p></article><article><p>Two parts of it.</p></article></body>") == "One part of it.\nTwo parts of it."
    assert html.extract("<div class=x><section><p>One part of it.</p></section><section><p>Two parts of it.</p></section></div>") == "One part of it.\nTwo parts of it."
    assert html.extract("<article><p>" + "Long story. " * 50 + "</p></article><article class=teaser><p>Another one.</p></article>") == ("Long story. " * 50).strip()


def test_long_paths_are_told_apart():
    deep = lambda last: "<div class=a>" * 90 + f"<div class={last}><p>Words.</p></div>"
    one, other = html.vote(deep("x"))[0], html.vote("<section>" + deep("x"))[0]
    assert len(one) == len(other) == 64 and one != other
    assert html.extract(deep("x"), one) == "Words."


def test_host_votes_match_a_plain_count(spark):
    """Pages without an article: the host's path decides where a page's own best container differs."""
    rng = random.Random(6)
    rows, truth = [], {}
    for i in range(60):
        host, body = f"h{i % 3}", " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(48, 60)))
        extra = " ".join(f"x{rng.randrange(999)}" for _ in range(40 if i % 9 == 4 else 6))
        names = (("post", "extra"), ("lead", "box"), ("blog", "list"))[i % 3]
        rows.append((i, f"https://{host}/p{i}", f"<html><body><div class='{names[0]}{i}'><p>{body}</p></div><div class='{names[1]}'><p>{extra} {extra}</p></div></body></html>"))
        truth[i] = body
    out = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out == truth
    assert any(html.extract(h) != truth[i] for i, _, h in rows)


def test_extract_pages(spark):
    rows = [(1, "http://h/1", PAGE, "x"), (1, "http://h/1", PAGE, "x"), (2, None, "", None), (None, None, None, None), (3, "http://h/3", "<div class='main1'><p>some words here</p></div>", "x")]
    schema = "page_id bigint, url string, html string, path string"
    out = html.extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert Counter((r.page_id, r.text) for r in out) == Counter({(1, html.extract(PAGE)): 2, (2, ""): 1, (None, ""): 1, (3, "some words here"): 1})
    assert html.extract_pages(spark.createDataFrame([], schema)).count() == 0


def test_extract_pages_salted_join(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    broadcast = sorted((r.page_id, r.text) for r in html.extract_pages(pages).collect())
    monkeypatch.setattr(html, "BROADCAST_HOSTS", 0)
    assert sorted((r.page_id, r.text) for r in html.extract_pages(pages).collect()) == broadcast


def test_consensus_moves_a_page(spark):
    usual = "<html><body><div class='post{i}'><p>{t}</p></div><div class='box'><p>{s}</p></div></body></html>"
    rows = [(i, "https://h/x", usual.format(i=i, t="main words " * 40, s="box " * 5)) for i in range(9)] + [(9, "https://h/y", usual.format(i=9, t="main words " * 30, s="box " * 90))]
    out = {r.page_id: r for r in html.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out[9].text == ("main words " * 30).strip() and out[9].path == "/html/body/div.post"


def test_pages_against_their_articles(spark):
    from html import unescape

    def article(page):
        body = re.sub(r"<[^>]*$", "", page.partition("<article>")[2].partition("</article>")[0]).replace("<br>", " ")
        return "\n".join(b for b in (" ".join(unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:h1|p)>", body)) if b)

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in queries.op1_html_extraction(spark, "/root/testdata/sf0.01").collect():
        assert r.text == article(pages[r.page_id]) and r.n_chars == len(r.text)


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = queries.op3_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(truth)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_cases(spark):
    data = helpers.frame(spark)
    model = langid.train(data)
    out = langid.identify(data, model).collect()
    assert len(out) == len(helpers.rows())
    assert all(r.lang_pred in ("en", "und") and 0 <= r.score <= 1 for r in out)
    unknown = {r.doc_id for r in out if r.lang_pred == "und"}
    assert unknown - {None} == {r[0] for r in helpers.rows() if r[0] is not None and not re.search(r"[^\W\d_]", r[1] or "")}
    empty = langid.train(helpers.frame(spark, []))
    assert {tuple(r)[1:] for r in langid.identify(data, empty).collect()} == {("und", 0.0)}
    assert langid.identify(helpers.frame(spark, []), model).count() == 0


def test_profiles_are_bound_and_bundled():
    e = langid.Encoder()
    v = lambda c: langid.letter_vectors(np.array([ord(c)])).astype(int)[0]
    want = np.zeros(langid.DIMENSIONS, int)
    for a, b, c in [("\0", "a", "b"), ("a", "b", "\0"), ("\0", "a", "\0")]:
        want += np.roll(v(a), 2) * np.roll(v(b), 1) * v(c)
    assert (e.profile("Ab, 12 a").astype(int) == want).all()
    assert e.profile("12 !") is None and e.profile(None) is None and e.profile("\u0301") is None
    many = "".join(chr(0x4E00 + i % 20000) + (" " if i % 7 == 0 else "") for i in range(90_000))
    assert np.isfinite(e.profile(many)).all() and (e.profile("ab") == langid.Encoder().profile("ab")).all()


def test_letters_have_vectors_of_their_own():
    points = np.array([*range(97, 123), 0x4E00, 0x4E00 + 255, 0x0915, 0x093F, 0x1F600])
    own = langid.letter_vectors(points).astype(int)
    common = own @ own.T / langid.DIMENSIONS - np.eye(len(points))
    assert abs(common).max() < 0.25
    e = langid.Encoder()
    assert len(e.trigrams("कि")[0]) == 2 and len(e.trigrams("क ि")[0]) == 2 and not (e.profile("一丁") == e.profile("丟乀")).all()


def test_predictions_match_plain_profiles(spark):
    """Cosines with prototypes made letter by letter, and the sample rule of the training texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()

    def plain(text):
        s = "\0" + re.sub(r"[^a-zß-ÿœ]+", "\0", (text or "").lower()).strip("\0") + "\0"
        grams = Counter(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != "\0")
        out = np.zeros(langid.DIMENSIONS)
        for g, n in grams.items():
            a, b, c = langid.letter_vectors(np.array([ord(x) for x in g])).astype(int)
            out += n * np.roll(a, 2) * np.roll(b, 1) * c
        return out

    sums = {}
    profiles = {r.doc_id: plain(r.text) for r in rows}
    for r in rows:
        if r.lang:
            sums[r.lang] = sums.get(r.lang, 0) + profiles[r.doc_id]
    units = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    mean = sum(units.values()) / len(units)
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    for d, p in profiles.items():
        own = p / np.linalg.norm(p) - mean
        scores = {k: own @ (u - mean) / np.linalg.norm(own) / np.linalg.norm(u - mean) for k, u in units.items()}
        best = min(scores, key=lambda k: (-scores[k], k))
        assert got[d].lang_pred == best and got[d].score == pytest.approx(max(0.0, min(1.0, scores[best])), abs=1e-5)


TURNS = [None, "", "plain", "\n\nleading and trailing \n ", "<|im_end|><|im_start|>assistant ok", "\\", "<", "|im_end|>", "<\\|", "a\\|b\\\\<|x|><", "é𝒳漢字🙂", "<|endoftext|>", "word " * 3000]


def test_chat_round_trip():
    t = chat.load_tokenizer(chat.tokenizer_path())
    rng = random.Random(4)
    for _ in range(120):
        turns = [(rng.choice(["user", "assistant", "system", "<|x|>\n", None, "assistant"]), rng.choice(TURNS)) for _ in range(rng.randrange(1, 6))]
        formatted, spans = chat.render(turns)
        assert chat.parse(formatted) == [(r or "", x or "") for r, x in turns]
        e = t.encode(formatted, add_special_tokens=False)
        offsets = np.array(e.offsets).reshape(-1, 2)
        on = chat.mask(offsets, spans)
        want = np.zeros(len(formatted), bool)
        for a, b in spans:
            want[a:b] = True
        for (a, b), x in zip(offsets, on, strict=True):
            assert want[a:b].all() == x and want[a:b].any() == x
        assert chat.masked_text(formatted, offsets, on) == "".join(x or "" for r, x in turns if r == "assistant")


def test_format_chats(spark):
    rows = [(1, 2, "assistant", "b", 1), (1, 1, "user", "a", 1), (2, None, None, None, 1), (None, 0, "assistant", "x", 1), (None, 0, "assistant", "x", 1), (3, 5, "assistant", "z", 1), (3, 5, "assistant", "y", 1)]
    schema = "conv_id bigint, turn bigint, role string, text string, turns int"
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, schema)).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("user", "a"), ("assistant", "b")] and out[1].loss_text == "b"
    assert [(t.role, t.text) for t in out[2].turns] == [("", "")] and out[None].loss_text == "xx" and out[3].loss_text == "yz"
    assert all(len(r.input_ids) == len(r.loss_mask) for r in out.values())
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_chat_query_digests(spark):
    own = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        own.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    own[-1] = [("user", TURNS[4]), ("assistant", TURNS[4])]
    got = queries.op8_chat_formatting(spark, SF).collect()
    assert len(got) == len(own)
    for r in got:
        loss = "".join(x for role, x in own[r.conv_id] if role == "assistant")
        turns = "".join(f"{role}\n{x}\n" for role, x in own[r.conv_id])
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own[r.conv_id]), helpers.sha(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokencount.tokenizer_path())


@pytest.fixture(scope="module")
def model():
    with open(tokencount.tokenizer_path(), "rb") as f:
        return f.read()


PARTS = ["a", "b", " ", "  ", "\n", "the ", "é", "▁", "\t", "<s>", "𝒳", "1", "\x00", "ing", "　", "</s>", "\r\n", "tion", "in", "er", "執", "http://", "    ", "...", "=="]


def test_transducer_matches_library(pieces, model, monkeypatch):
    rng = random.Random(1)
    scores = tokencount.load_pieces(model)
    kept, tight = tokencount.Transducer(scores), tokencount.Transducer(scores, 40, 3)
    for _ in range(600):
        x = "".join(rng.choice(PARTS) for _ in range(rng.randrange(50)))
        for size in (1 << 14, 1, 2, 3, 7):
            monkeypatch.setattr(tokencount, "CHUNK", size)
            assert kept.count(x) == tight.count(x) == len(pieces.encode(x)), (size, x)


def test_states_hold_every_prefix_count(pieces, model):
    """After each character the sum of the transitions is the count of the text so far."""
    t = tokencount.Transducer(tokencount.load_pieces(model))
    text, state, n = " the unbelievable  international ation 12345 ééa", None, 0
    state = t.start
    for i, c in enumerate(text):
        state, added = state[c]
        n += added
        assert n == len(pieces.encode(text[1 : i + 1])) or i == 0


def test_chunk_maps_compose_in_any_order(pieces, model):
    t = tokencount.Transducer(tokencount.load_pieces(model))
    rng = random.Random(9)
    for text in (" the cat  sat\n\non a mat " * 3, " abcabcabcinternationalisation", " " * 40):
        for _ in range(50):
            cuts = sorted(rng.sample(range(1, len(text)), 5))
            maps = [t.chunk(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            while len(maps) > 1:
                i = rng.randrange(len(maps) - 1)
                maps[i : i + 2] = [maps[i].then(maps[i + 1])]
            assert maps[0](t.start)[1] == len(pieces.encode(text[1:]))


def test_other_models_are_refused(model):
    field = lambda n, v: bytes([n << 3 | 2, len(v)]) + v
    trainer, plain = field(2, b"\x18\x02\x98\x02\x01"), b"\x18\x01\x20\x00\x28\x01"
    piece = field(1, field(1, b"a") + b"\x15\x00\x00\x80\xbf")
    assert tokencount.load_pieces(piece + trainer + field(3, plain)) == {"a": -1.0}
    for bad in (trainer + field(3, b"\x12\x01x" + plain), trainer + field(3, b"\x20\x01"), field(2, b"\x18\x01") + field(3, plain), field(1, field(1, b"a") + b"\x18\x04") + trainer + field(3, plain)):
        with pytest.raises(ValueError):
            tokencount.load_pieces(bad)


def test_token_counts(spark, pieces):
    long = "word" * 40_000
    rows = [*helpers.rows(), (900, long, *NONE), (901, "x y " * 40_000, *NONE)]
    out = tokencount.token_counts(helpers.frame(spark, rows))
    want = Counter((r[0], len((r[1] or "").encode()), n := len(pieces.encode(r[1] or "")), n > 4096) for r in rows)
    assert Counter(map(tuple, out.collect())) == want
    assert tokencount.token_counts(helpers.frame(spark, [])).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_tokens == len(pieces.encode(texts[r.doc_id])) for r in tokencount.token_counts(docs).collect())


def test_queries_are_registered():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}
    assert F is not None
