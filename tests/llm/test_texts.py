import hashlib
import zlib

import numpy as np
import pytest

from heddle.llm import chat, common, html_extract, langid, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---------------------------------------------------------------- language ID
WORDS = {"aa": "kal mira tonu sela", "bb": "grüß strax wühl qant"}


def corpus(n=300):
    rng = np.random.default_rng(1)
    out = []
    for i in range(n):
        lang = "aa" if i % 2 else "bb"
        out.append((i, " ".join(rng.choice(WORDS[lang].split(), 1 + i % 40)), lang, "s", 1))
    return out


def test_gradient():
    net = langid.Network(["a", "b", "c"], 3, 1)
    for k in "xuvb":
        setattr(net, k, getattr(net, k).astype(np.float64))
    rng = np.random.default_rng(0)
    w, y, used = rng.integers(97, 105, (6, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.ones((6, 5))
    used[4:, 2] = 0
    _, grads = net.gradient(w, y, used)
    for k, g in zip("xuvb", grads, strict=True):
        a = getattr(net, k)
        for _ in range(8):
            i = tuple(int(rng.integers(n)) for n in a.shape)
            was = a[i]
            a[i] = was + 1e-3
            up = net.gradient(w, y, used)[0]
            a[i] = was - 1e-3
            down = net.gradient(w, y, used)[0]
            a[i] = was
            assert (up - down) / 2e-3 == pytest.approx(g[i], abs=2e-4)


def test_pooling_reads_every_position():
    net = langid.Network(["a", "b"], 4, 3)
    texts = ["", "x", "é" * 33, "abc " * 500]
    got = langid.probabilities(net, texts, span=16, side=8)
    for t, p in zip(texts, got, strict=True):
        raw = t.encode()
        if not raw:
            assert (p == 0).all()
            continue
        parts = [net.positions(np.frombuffer(raw[i : i + 16].ljust(16), np.uint8)[:, None])[: len(raw[i : i + 16]), :, 0] for i in range(0, len(raw), 16)]
        assert p == pytest.approx(np.concatenate(parts).mean(0), abs=1e-5)


def test_language(spark):
    rows = corpus() + [(1000, None, "aa", None, None), (1001, "", "aa", "s", 0), (1002, "123 ...", None, "s", 0), (None, "kal mira", None, "s", 1), (1, "kal tonu sela", "aa", "s", 1), (1003, "mira " * 50_000, None, "s", 1)]
    d = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "score")
    got = {}
    for r in langid.identify(d, max_docs=60).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert [got[i][0].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000][0].score == 0
    held = [r[0] for i, r in got.items() if i is not None and i < 300 and r[0].held_out]
    truth = {r[0]: r[2] for r in corpus()}
    assert len(held) > 30 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert got[1003][0].lang_pred == "aa" and got[None][0].lang_pred == "aa" and all(0 <= r[0].score <= 1 for r in got.values())
    assert langid.identify(d.where("false")).count() == 0
    blank = d.where("doc_id < 5").drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r.lang_pred for r in langid.identify(blank).collect()} == {"und"}
    kept = langid.keep_known(d, langid.fit(d, 60))
    assert kept.columns == d.columns and {1000, 1001, 1002}.isdisjoint(r.doc_id for r in kept.collect()) and kept.where("doc_id < 300").count() == 301


def test_unrecognised_texts_go(spark):
    rng = np.random.default_rng(11)
    words = {lang: ["".join(rng.choice(list(letters), 5)) for _ in range(40)] for lang, letters in {"aa": "abcdé", "bb": "fghiö", "cc": "klmnñ", "dd": "oprst"}.items()}
    rows = [(i, " ".join(rng.choice(w, 60)), lang) for i, (lang, w) in enumerate([*words.items()] * 40)]
    odd = ["中文字符的文章内容非常好" * 8, "съешь ещё этих мягких французских булок " * 8, "نص حكيم له سر قاطع وذو شأن عظيم " * 8, " ".join(x for t in zip(*words.values(), strict=True) for x in t)]
    d = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows] + [(1000 + i, t, None, "s", 1) for i, t in enumerate(odd)] + [(1100, rows[0][1].upper().replace("É", "é"), None, "s", 1)], DOCS)
    assert {r.doc_id for r in langid.keep_known(d, langid.fit(d)).collect()} == {r[0] for r in rows} | {1100}


# ---------------------------------------------------------------- html
def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


LONG = "A first sentence of the article which is long enough to count as content of the page."


@pytest.mark.parametrize(("html", "want"), [
    (None, ""), ("", ""), ("<p>", ""), ("<script>x</script>", ""),
    ("plain  text\n here", "plain text here"),
    (page(f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p><b>{LONG}<br><p>Short.</p></article><footer>&copy; x</footer>"), f"Title\n\n{LONG}\n\nShort."),
    (page(f"<div class='ad'>Buy</div><div id=content><p>{LONG}</p><p>a &lt;b&gt; &amp;&amp; c&#33;</p></div><aside>side</aside><div class='comments'><p>{LONG} I disagree</p></div>"), f"{LONG}\n\na <b> && c!"),
    (page(f"<div class=cookie-notice>We use cookies and like it very much indeed</div><main><p>{LONG}</p><form><p>Sign up</p><input></form><ul><li>one<li>two</ul></main>"), f"{LONG}\n\none\n\ntwo"),
    (page(f"<nav><ul><li>menu<article><p>{LONG}<p>end"), f"{LONG}\n\nend"),
    (page(f"<div class='layout has-sidebar'><div class='site-header'><p>{LONG} Site</p></div><div id=post><div class='entry-body'><p>{LONG}</p><p>{LONG}</p></div></div><div class='sponsored'>{LONG}</div></div>"), f"{LONG}\n\n{LONG}"),
    (page(f"<ul><li><a href=/1>one</a></li><li><a href=/2>two</a></li><li><a href=/3>three</a></li></ul><p>{LONG}</p><p><a href=/4>a link</a></p><p>{LONG}</p>"), f"{LONG}\n\na link\n\n{LONG}"),
    (page(f"<article><div class='article-header'><h1>Title</h1></div><p>{LONG}</p><div class='notice'>Read this notice please</div><p>tail</p></article><section id=reader-comments><p>{LONG}</p></section>"), f"Title\n\n{LONG}\n\ntail"),
    (page(f"<div class=widget><p>{LONG}</p></div>"), LONG),
    (page("<div class='share-widget'><p>Short article text.</p></div>"), "Short article text."),
    (f"<html><head><title>T</title><body><p>{LONG}<p>end</body></html>", f"{LONG}\n\nend"),
    (f"<html><head><meta charset=utf-8><title>T</title><p>{LONG}<p>end", f"{LONG}\n\nend"),
    (f"<head><title>T</title>{LONG}", LONG),
    (page(f"<article><p>{LONG}</p><ul><li><a href=/1>one</a><li><a href=/2>two</a><li><a href=/3>three</a></ul><p>{LONG}</p><ul><li><a href=/1>one</a><li><a href=/2>two</a><li><a href=/3>three</a></ul></article>"), f"{LONG}\n\none\n\ntwo\n\nthree\n\n{LONG}\n\none\n\ntwo\n\nthree"),
    (page(f"<p>{LONG}</p><ul><li><a href=/1>one</a><li><a href=/2>two</a><li><a href=/3>three</a></ul><p>{LONG}</p>"), f"{LONG}\n\none\n\ntwo\n\nthree\n\n{LONG}"),
    (page(f"<article><p>{LONG} As <math><mi>x</mi><mo>&lt;</mo><mn>2</mn><annotation>x lt 2</annotation></math> holds.</p></article>"), f"{LONG} As x<2 holds."),
    (page(f"<div class=widget>{f'<p>{LONG}</p>' * 8}</div><p>tail</p><div class='comments'><p>{LONG}</p></div>"), "\n\n".join([LONG] * 8 + ["tail", LONG])),
    (page("<div class=widget>" + f"<p>{LONG}</p>" * 8 + "</div>"), "\n\n".join([LONG] * 8)),
    (page(f"<article><p>{LONG}</p><article class='comment'><p>{LONG} no</p></article><p>last</p></article>"), f"{LONG}\n\nlast"),
])
def test_extract(html, want):
    assert html_extract.extract(html) == want


@pytest.mark.parametrize(("html", "want"), [
    (page(f"<article><h1>Title</h1><section>{f'<p>{LONG}</p>' * 7}</section><section>{f'<p>{LONG}</p>' * 13}</section></article>"), ["Title"] + [LONG] * 20),
    (page(f"<div><h1>Title</h1><p>{LONG} Lead.</p><div class=body>{f'<p>{LONG}</p>' * 9}</div></div>"), ["Title", f"{LONG} Lead."] + [LONG] * 9),
    (page(f"<h1>T</h1><div class=meta><span>by</span> <i>a</i> <b>b</b> <i>c</i> <b>d</b></div><div class=body>{f'<p>{LONG}</p>' * 9}</div>"), ["T", "by a b c d"] + [LONG] * 9),
    (page(f"<h1>Title</h1><article>{f'<p>{LONG}</p>' * 9}</article><div>unmarked</div>"), ["Title"] + [LONG] * 9),
    (page(f"<div>{f'<p>{LONG}</p>' * 7}</div><div>{f'<p>{LONG}</p>' * 13}</div>"), [LONG] * 20),
    (page(f"<article>{f'<p>{LONG}</p>' * 7}</article><article>{f'<p>{LONG}</p>' * 13}</article>"), [LONG] * 20),
    (page(f"<main><h1>Title</h1><article><div>{f'<p>{LONG}</p>' * 9}</div></article></main><div><p>{LONG} Unmarked</p></div>"), ["Title"] + [LONG] * 9),
])
def test_extract_keeps_all_sections(html, want):
    assert html_extract.extract(html) == "\n\n".join(want)


def unnamed(n):
    """A page without an element or name that tells what is what: menu, article with short lines, small print; and the article."""
    rng = np.random.default_rng(n)
    article = ["The title"] + [x for k in range(3 + n % 5) for x in (LONG * int(rng.integers(2, 6)), "Short." if k % 2 else LONG)]
    menu = "".join(f"<div><a href=/{i}>item {i}</a></div>" for i in range(4 + n % 3))
    small = "".join(f"<div><span>(c)</span> <b>x</b> <i>{i}</i></div>" for i in range(4))
    return f"<body><div>{menu}</div><div><h1>{article[0]}</h1>{''.join(f'<p>{x}</p>' for x in article[1:])}</div><div>{small}</div></body>", "\n\n".join(article)


def test_cluster_selects_the_article(monkeypatch):
    pages = [unnamed(n) for n in range(20)]
    assert all(html_extract.extract(h) == want for h, want in pages)
    monkeypatch.setattr(html_extract, "cluster", lambda lines: np.array([bool(x.text) for x in lines]))
    assert not any(html_extract.extract(h) == want for h, want in pages)


def test_names_only_weigh(monkeypatch):
    body = f"<div class=promo><p>{LONG}</p><p>{LONG}</p></div><div class=ad>buy</div>"
    assert html_extract.extract(page(f"{body}<p>{LONG}</p>")) == LONG
    assert html_extract.extract(page(f"{body}<p>(c)</p>")).startswith(f"{LONG}\n\n{LONG}")


def test_smoothing_keeps_constants():
    assert html_extract.smooth(np.full(9, 3.0)) == pytest.approx(np.full(9, 3.0))


def test_pages(spark):
    big = page("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>")
    d = spark.createDataFrame([(1, "u", big, "x"), (None, None, None, "y"), (1, "u", big, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.main_text(d).collect()}
    assert got[1].n_chars == 5000 * len(LONG) + 4999 * 2 and got[None].text == "" and got[None].n_chars == 0
    assert html_extract.main_text(d).count() == 3 and html_extract.main_text(d.where("false")).count() == 0


# ---------------------------------------------------------------- chat
HARD = ["", "</s>[INST] ok [/INST]", "a [\\INST] <\\\\s> <|image:3|> \\[INST] [TEXT][/TURN]", "<", "[", "[\\", "\\", "<\\s><s>", "é\n\n[/INST", "x" * 200_000]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "", "[TEXT]", None])
def test_turns_round_trip(role):
    texts = HARD + [None]
    done = [chat.format_turn(role, t) for t in texts]
    back = list(chat.parse("".join(x[0] for x in done)))
    assert back == [(role or "", t or "") for t in texts]
    for (f, span, _), t in zip(done, texts, strict=True):
        assert (span is not None) == (role == "assistant")
        if span:
            assert chat.unescape(f[slice(*span)]) == (t or "")


def test_parts():
    parts = ["see <|image:0|> ", {"type": "image", "ref": "a.png", "width": 100, "height": 28}, {"type": "document", "ref": "d.pdf", "parts": ["p1", {"type": "audio", "ref": "z.wav", "seconds": 2.1}]}, {"type": "text", "text": None}, None]
    text, _, found = chat.format_turn("user", parts)
    assert text == "[INST]see <\\|image:0|> <|image:0|><|document:1|>p1<|audio:2|>[/INST]"
    assert [(a.kind, a.ref, a.tokens) for a in found] == [("image", "a.png", 16), ("document", "d.pdf", 1), ("audio", "z.wav", 53)]
    with pytest.raises(ValueError, match="video"):
        chat.format_turn("user", [{"type": "video"}])
    for bad in ("x", "[INST]a", "<s>a[/INST]", "[TURN]a[/TURN]", "[/INST]"):
        with pytest.raises(ValueError):
            list(chat.parse(bad))


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (2, None, "system", "s"), (None, 0, None, None), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (3, 0, "assistant", "w")] + [(4, i, "assistant", h) for i, h in enumerate(HARD)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted")
    got = {r.conv_id: r for r in chat.round_trip(d).collect()}

    def sha(*turns):
        return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()

    assert set(got) == {1, 2, 3, 4, None}
    assert got[1].turns_sha256 == sha(("user", "a"), ("assistant", "b")) and got[1].loss_chars == 1 and got[1].formatted_chars == len("[INST]a[/INST]<s>b</s>")
    assert got[2].turns_sha256 == sha(("system", "s"), ("user", "")) and got[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].n_turns == 3 and got[3].loss_sha256 == hashlib.sha256(b"wxx").hexdigest()
    assert got[4].loss_sha256 == hashlib.sha256("".join(HARD).encode()).hexdigest() and got[4].loss_chars == sum(map(len, HARD))
    assert got[None].turns_sha256 == sha(("", "")) and chat.round_trip(d.where("false")).count() == 0


def test_ties_go_by_the_texts_themselves(spark):
    rows = [(1, 0, "user", "<0"), (1, 0, "user", "</s>"), (1, 0, "user", "<a"), (1, 0, "user", "[INST]x")]
    (r,) = chat.round_trip(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert r.turns_sha256 == hashlib.sha256("".join(f"user\n{x}\n" for x in sorted(x[3] for x in rows)).encode()).hexdigest()


def test_typed_content_column(spark):
    kind = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double>>"
    d = spark.createDataFrame([(1, 0, "user", [("text", "hi", None, None, None, None), ("image", None, "i.png", 14, 14, None)])], f"conv_id long, turn long, role string, content {kind}")
    r = chat.format_turns(d, "content").first()
    assert r.formatted == "[INST]hi<|image:0|>[/INST]" and [tuple(a) for a in r.attachments] == [("image", "i.png", 1)]


# ---------------------------------------------------------------- toxicity
def toxic_corpus(n=400):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(n):
        words = rng.choice("alpha beta gamma delta omega sigma lambda kappa".split(), 5 + i % 60).tolist()
        y = int(i % 4 == 0)
        if y:
            words[i % 5] = ["vileword", "vilewords", "nastyone"][i % 3]
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, y))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_corpus()
    extra = [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "alpha " * 30_000 + "vileword", "en", "s", 1), (None, "some vilewordy text", "en", "s", 1), (4, docs[4][1], "en", "s", 1)]
    d = spark.createDataFrame(docs + extra, DOCS).withColumnRenamed("lang", "score")
    y = spark.createDataFrame(labels + [(None, 1, 1), (7, None, None), (9, 0, 5)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, y)
    got = {}
    for r in toxicity.score(d, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(docs) + len(extra)
    truth = {i: t for i, _, t in labels}
    held = [got[i][0] for i in truth if got[i][0].held_out]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert [got[i][0].predicted for i in (1000, 1001, 1002, None)] == [0, 0, 1, 1] and got[1002][0].evidence
    assert all(0 <= r[0].score <= 1 and r[0].predicted == int(r[0].score >= 0.5) for r in got.values())
    kept = toxicity.drop_toxic(d, model)
    assert kept.columns == d.columns and 1002 not in {r.doc_id for r in kept.collect()}
    assert toxicity.score(d.where("false"), model).count() == 0
    none = toxicity.fit(d, y.where("toxic = 0"))
    assert {r.score for r in toxicity.score(d, none).collect()} == {0.0}
    assert toxicity.fit(d.where("false"), y.where("false")).rate == 0


def brute_scores(docs, labels):
    """The same scores by dense vectors and all similarities, from the examples that a fit without bounds takes."""
    counts = {i: toxicity.words(t) for i, t in docs.items()}
    ids = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 5)
    y = np.array([labels[i] for i in ids])
    terms, gain = toxicity.vocabulary([counts[i] for i in ids], y)
    dense = {}
    held = np.zeros(len(terms))
    for i, c in counts.items():
        v = np.zeros(len(terms))
        for w, n in c.items():
            t = next((terms[w[:at]] for at in range(len(w), 0, -1) if w[:at] in terms and (at == len(w) or at >= toxicity.STEM)), None)
            if t is not None:
                v[t] += n
        held += v > 0
        dense[i] = np.where(v > 0, 1 + np.log(np.maximum(v, 1)), 0)
    scale = (np.log((1 + len(docs)) / (1 + held)) + 1) * gain
    unit = {i: v * scale / max(1e-300, np.sqrt(((v * scale) ** 2).sum())) for i, v in dense.items()}
    telling = gain > toxicity.TELLING
    kind = np.array([1 if labels[i] else 2 if (dense[i][telling] > 0).any() else 0 for i in ids])
    rate = y.mean()

    def vote(q, but=None):
        s = sorted((-round(float(unit[i] @ q), 12), i, labels[i]) for i in ids if i != but and unit[i] @ q > 0)[: toxicity.K]
        w = np.array([1 / (1.05 - min(-x, 1.0)) ** 2 for x, _, _ in s])
        return ((w * [k for _, _, k in s]).sum() + rate) / (w.sum() + 1) if s else None

    votes = [(vote(unit[i], i), labels[i]) for i in ids]
    votes = [v for v in votes if v[0] is not None]
    assert kind.any()  # every example is drawn, so each weighs 1
    knots = toxicity.isotonic(np.array([v for v, _ in votes]), np.array([float(k) for _, k in votes]), np.ones(len(votes)))
    out = {}
    for i, q in unit.items():
        v = vote(q)
        out[i] = rate if v is None else min(max(float(np.interp(v, *knots)), 0.001), 0.999)
    return out


def test_scores_against_brute_force(spark):
    rng = np.random.default_rng(12)
    plain = [a + b for a in "ba co di fu ge lo mi".split() for b in "nar tel sim rop vu x".split()]
    docs, labels = {}, {}
    for i in range(400):
        w = rng.choice(plain, rng.integers(4, 60)).tolist()
        labels[i] = int(rng.random() < 0.25)
        if labels[i] or i % 90 == 0:  # words of two and three letters tell too
            w[1 : 1 + i % 3 + 1] = rng.choice(["zu", "kix", "vexatious"], i % 3 + 1).tolist()
        docs[i] = " ".join(w)
    docs[5], docs[6], docs[7] = "", "12 34", "Vexatiously, plainly unknown"
    labels = {i: y for i, y in labels.items() if i not in (5, 6, 7) and i % 4}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    y = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(d, toxicity.fit(d, y)).collect()}
    want = brute_scores(docs, labels)
    assert {i: r.score for i, r in got.items()} == pytest.approx(want)
    assert got[7].predicted == 1 and got[5].score == got[6].score
    assert all(r.evidence for i, r in got.items() if i not in (5, 6))


def test_index_is_exact():
    rng = np.random.default_rng(4)
    vs = []
    for _ in range(500):
        t = np.sort(rng.choice(60, rng.integers(0, 9), replace=False))
        w = rng.random(len(t)) + 0.05
        vs.append((t, w / np.sqrt((w * w).sum()) if len(t) else w))
    ids = rng.permutation(500)
    index = toxicity.BlockMaxIndex(vs, ids, 60, 16)
    dense = np.zeros((500, 60))
    for i, (t, w) in enumerate(vs):
        dense[i, t] = w
    for q in range(60):
        s = dense @ dense[q]
        hit = np.flatnonzero(s > 0)
        want = [int(ids[i]) for i in sorted(hit, key=lambda i: (-round(s[i], 12), ids[i]))[:15]]
        places, near = index.nearest(vs[q])
        assert [int(index.ids[p]) for p in places] == want
        assert near == pytest.approx(np.minimum(np.sort(s[hit])[::-1][:15], 1.0))


def test_isotonic_rises():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert y.tolist() == [0.0, 0.5, 1.0] and x == pytest.approx([0.1, 0.25, 0.4])


def test_folds(spark):
    import zlib

    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(50).select(common.fold_of(F.col("id"))).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 5 for i in range(50)]
