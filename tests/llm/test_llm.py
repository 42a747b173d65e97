"""Operators of tidewatch.llm: brute force, round trips and edge rows."""

import collections
import fractions
import hashlib
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import chat, decontaminate, entries, graph, html_text, language, lm_score, mixing, near_duplicates, secrets, token_counts, top_k
from tidewatch.llm._text import cut, shared_dir

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, spans string, score double"


def edge_docs(spark, more=()):
    """Null and empty texts, a long one, repeated rows, ties, null ids, and columns with clashing names."""
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "a b c"), (None, "a b c"), (5, "x " * 20000), (6, " \t "), (7, "é ü 漢字 😀 word"), *more]
    return spark.createDataFrame([(i, t, "en", None, 0, 9, "s", 0.5) for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def groups_of(rows):
    """Brute force: (set size, component) by id."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    shared = [rng.choice(vocabulary) for _ in range(40)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    for _ in range(90):  # a large group of copies with any number of edits, so that many pairs are near the limit
        w = list(base)
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((n, " ".join(w)))
        n += 1
    for _ in range(60):  # a shared passage between own words
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 80))]
        rows.append((n, " ".join(w[:10] + shared + w[10:])))
        n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df).collect()}
    assert got == groups_of(rows)


def test_near_duplicates_at_any_number_of_levels(spark):
    """A family that shares half of its shingles, below the limit, with some true copies in it."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = [base + [f"o{rng.randrange(100000)}" for _ in range(50)] for _ in range(240)]
    texts += [w[:-1] + ["end"] for w in texts[::9]]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups_of(rows)
    for levels in (1, 3):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df, levels=levels).collect()} == want


def test_near_duplicates_edges(spark):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(edge_docs(spark)).collect())
    assert got[1, 0, 1, True] == got[2, 0, 2, True] == got[6, 0, 6, True] == 1
    assert got[3, 1, 3, True] == 2 and got[4, 1, 3, False] == 1 and got[None, 1, 3, False] == 1
    assert got[5, 1, 5, True] == 1 and sum(got.values()) == 9
    assert near_duplicates.near_duplicates(edge_docs(spark).limit(0)).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    rows = [(8, a), (5, a[:-1] + ["z"]), (5, b), (9, b[:-1] + ["z"]), (7, c), (None, c), (None, ["q"] * 9), (6, []), (6, a[:20] + c[:20])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").withColumn("group", F.lit(1)).withColumn("row", F.lit("r"))
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates.near_duplicates(df).collect())
    assert got == collections.Counter({(8, 5, False): 1, (5, 5, True): 2, (9, 5, False): 1, (7, 7, True): 1, (None, 7, False): 1, (None, None, False): 1, (6, 6, True): 2})
    # One of each group of texts: no text goes that has no near-duplicate among those that stay.
    rows = [(3, b), (5, a), (5, b), (5, a), (None, a), (None, c), (None, c), (4, []), (4, []), (2, c[:-1] + ["z"])]
    df = spark.createDataFrame([(i, " ".join(w), k) for k, (i, w) in enumerate(rows)], "doc_id long, text string, k int")
    got = sorted(near_duplicates.without_near_duplicates(df).select("k").toPandas().k)
    assert got == [0, 1, 7, 8, 9]
    assert near_duplicates.without_near_duplicates(df.limit(0)).count() == 0


def test_attach_deals_common_classes(spark):
    rows = spark.createDataFrame([(i, i, 2, 7, 7) for i in range(3000)] + [(9000 + i, i, 2, i, 8) for i in range(2000)] + [(1, 1, 0, 0, 0)], "id long, row long, n long, h1 long, h2 long")
    classes = rows.where("n > 0").groupBy("n", "h1", "h2").agg(F.count("*").alias("k"), F.min("id").alias("v"))
    got = {(r.id, r.h2): r.v for r in near_duplicates._attach(rows, classes, "v").collect()}
    assert len(got) == 5001 and all(v == (0 if h == 7 else i if h == 8 else None) for (i, h), v in got.items())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_block_comparison_is_exact():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(20)]
    t = pa.table({"id": pa.array(range(20), pa.int64()), "c": pa.array(range(20), pa.int64()), "shingles": [s.tobytes() for s in sets]})
    out = near_duplicates._block(50)(t, t)
    got = set(zip(out["a"].to_pylist(), out["b"].to_pylist()))
    want = {(a, b) for a in range(20) for b in range(a + 1, 20) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 50 * len(np.union1d(sets[a], sets[b]))}
    assert got == want


def brute_hits(text, items, width=13):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, t in items:
        p = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        m = min(width, len(p))
        for i in range(len(p) - m + 1 if m else 0):
            for at in range(len(w) - m + 1):
                if w[at : at + m] == p[i : i + m]:
                    hit.update(range(at, at + m))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("chars", [2_000_000, 40])
def test_decontaminate_brute_force(spark, chars):
    rng = random.Random(1)
    line = lambda n: " ".join(rng.choice("ab cd ef gh".split()) for _ in range(n))
    items = [(1, line(20)), (2, line(13)), (3, "ab cd ef"), (4, "QQ"), (5, None), (6, "..."), (7, line(14)), (2, "AB, Cd;ef gh")]
    texts = [line(400), line(5), items[0][1] + " zz " + items[1][1].upper(), "qq", "x qq-qq", None, ""]
    texts += [line(20) + " " + items[0][1][:-1] for _ in range(5)]
    rows = list(enumerate(texts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(edge_docs(spark, [(10 + i, t) for i, t in rows]), bench, block_chars=chars).collect()}
    for i, t in rows:
        assert got[10 + i] == brute_hits(t, items), i
    assert got[1] == (0, 0, []) and got[5][0] == 20000
    assert decontaminate.decontaminate(edge_docs(spark), bench.limit(0)).where("n_hit > 0").count() == 0


def test_secrets(spark):
    import base64

    der = b"\x30\x26\x02\x01\x00\x04\x21" + bytes(range(33))
    key = base64.b64encode(der).decode()
    head = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    body = base64.urlsafe_b64encode(b'{"sub":"1"}').decode().rstrip("=")
    text = f"😀 Token = abcdef, token: abc; AKIA{'A' * 16} {'0a' * 12} {head}.{body}.sig_ {key} {'A' * 60}"
    found = secrets.find_secrets(text)
    assert {k for k, _, _ in found} == {"assign", "access", "hex", "jwt", "key"}
    assert text[found[0][1] : found[0][2]] == "Token = abcdef"
    assert not secrets.is_key(der[:-1]) and not secrets.is_key(der + b"\0") and secrets.is_key(der)
    public = b"\0\0\0\x0bssh-ed25519\0\0\0\x20" + bytes(32)
    assert not secrets.is_key(public) and secrets.is_key(public + b"\0\0\0\x40" + bytes(64) + bytes(4))
    out = secrets.scan_secrets(edge_docs(spark, [(20, text)]), mark="[REDACTED]")
    assert out.count() == 10 and dict(out.dtypes)["spans"].startswith("array")
    assert out.where("doc_id <> 20 and not redacted <=> text").count() == 0
    clean = out.where("doc_id = 20").first().redacted
    assert "AKIA" not in clean and clean.startswith("😀 [REDACTED], token: abc; ") and clean.endswith("A" * 60)


def test_secrets_keys_by_their_parts_and_linear_time():
    import base64

    def der(tag, *parts):
        body = b"".join(parts)
        n = len(body)
        return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82, n >> 8, n & 255])) + body

    number, oid = der(2, b"\x01" * 128), der(0x30, der(6, b"\x2a\x86\x48"), b"\x05\x00")
    version, secret = der(2, b"\0"), der(4, b"\x07" * 40)
    private = [der(0x30, version, *[number] * 8), der(0x30, version, oid, secret), der(0x30, der(2, b"\1"), secret), der(0x30, oid, secret)]
    public = [der(0x30, number, der(2, b"\1\0\1")), der(0x30, oid, der(3, b"\0" * 140)), der(0x30, der(0x30, number, oid), oid, der(3, b"\0" * 140))]
    assert [secrets.is_key(x) for x in [*private, *public]] == [True] * 4 + [False] * 3
    for x, end in zip(private, ["\n", "\r\n", "\\n", "\n"]):
        plain = base64.b64encode(x).decode()
        lines = end.join(plain[i : i + 64] for i in range(0, len(plain), 64))
        found = secrets.find_secrets(f"see {lines} there")
        assert ("key", 4, 4 + len(lines)) in found
    began = time.perf_counter()
    for text in ("eyJ" * 100_000, "A" * 1_000_000, ("A" * 64 + "\n") * 15_000, "token=abcdefg " * 20_000, "-----BEGIN PRIVATE KEY-----\n" * 20_000, "secret" + " " * 500_000):
        secrets.redacted(text, secrets.find_secrets(text))
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n", "\\r\\n", "\\\\n"])
def test_pem_line_ends_headers_and_ssh_files(end):
    import base64
    import json

    def block(kind, data, headers=()):
        key = base64.b64encode(data).decode()
        return end.join([f"-----BEGIN {kind}-----", *headers, *[key[i : i + 64] for i in range(0, len(key), 64)], f"-----END {kind}-----"])

    def pems(text):
        return [text[a:b] for k, a, b in secrets.find_secrets(text) if k == "pem"]

    field = lambda x: len(x).to_bytes(4, "big") + x
    der = b"\x30\x81\x86\x02\x01\x00\x04\x81\x80" + bytes(range(128))
    public = field(b"ssh-ed25519") + field(bytes(32))
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + b"\0\0\0\1" + field(public) + field(bytes(136))
    aes = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC," + "0A" * 16, ""]
    good = [block("PRIVATE KEY", der), block("OPENSSH PRIVATE KEY", ssh), block("RSA PRIVATE KEY", bytes(range(160)), aes), block("RSA PRIVATE KEY", der, ["Comment: mine", ""])]
    for text in good:
        assert pems(f"a {text} b") == [text]
        assert secrets.find_secrets(json.dumps({"private_key": text}))[0][0] == "pem"
    bad = [block("PRIVATE KEY", der[:-1]), block("OPENSSH PRIVATE KEY", ssh[:-1]), block("OPENSSH PRIVATE KEY", b"openssh-key-v1\0" + bytes(80)), block("RSA PRIVATE KEY", bytes(range(159)), aes)]
    assert not any(pems(text) for text in bad)


def test_chat_round_trip(spark):
    rows = [(1, 1, "user", "a<|end|>b"), (1, 2, "user", "</s>[INST] <\\|x|>"), (1, 3, "assistant", None), (1, 4, "assistant", "z\\[/INST]"), (1, 4, "assistant", "z\\[/INST]"), (2, None, None, "<|turn|>"), (None, 1, "assistant", "né😀")]
    rows += [(3, i, "assistant" if i % 3 else "user", f"é{i} " * 50) for i in range(600)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, mask int")
    got = {}
    for r in chat.format_chats(df).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.masked_text(F.col("formatted"), F.col("mask"))).collect():
        got[r.conv_id] = ([tuple(t) for t in r.turns], r.learned)
        at, under = 0, ""
        for chars, size, loss in r["mask"]:
            part = r.formatted[at : at + chars]
            assert len(part.encode()) == size
            under += re.sub(r"([<\[])\\(\\*(?:\||/?s>|/?INST\]))", r"\1\2", part) if loss else ""
            at += chars
        assert at == len(r.formatted) and under == r.learned == "".join(t for role, t in got[r.conv_id][0] if role == "assistant")
    assert got[1] == ([("user", "a<|end|>b"), ("user", "</s>[INST] <\\|x|>"), ("assistant", ""), ("assistant", "z\\[/INST]"), ("assistant", "z\\[/INST]")], "z\\[/INST]z\\[/INST]")
    assert got[2] == ([("", "<|turn|>")], "") and got[None][1] == "né😀"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>menu</li></ul></nav><div class="site-header">H</div>
    <article><h1>Head &amp; tail</h1><p>One <b>bo</b>ld&nbsp; line<br>two</p><aside>side</aside><div class="ad">buy</div><p>x</p><form><p>mail?</p></form></article>
    <section id="comments"><p>first!</p></section><footer>&copy;</footer></body></html>"""
    assert html_text.main_text(page) == "Head & tail\n\nOne bold line two\n\nx"
    soup = "<div class=menu><a href=1>one</a><a href=2>two</a></div><div><p>" + "long text " * 20 + "</p><p>short.</p></div><div class=notice>cookies</div>"
    assert html_text.main_text(soup) == ("long text " * 20).strip() + "\n\nshort."
    assert html_text.main_text("") == "" and html_text.main_text("<p>tiny") == "tiny"
    assert html_text.main_text("<script>if (a<b) {'</p>'}</script><p>ok</p><!-- <p>no</p> -->") == "ok"


def test_html_names_that_hold_the_page_and_broken_tags():
    body = "<p>" + "long text " * 20 + "</p>"
    text = ("long text " * 20).strip()
    for name in ("page has-sidebar", "social-policy-report"):
        assert html_text.main_text(f'<div class="{name}">{body * 2}</div>') == f"{text}\n\n{text}"
        assert html_text.main_text(f'<main><div class="{name}">{body * 2}</div></main>') == f"{text}\n\n{text}"
    for wrapper in ('class="alert"', 'class="content menu"', 'role="dialog"', 'id="widget"'):
        assert html_text.main_text(f"<nav><a href=1>one</a> of many</nav><div {wrapper}>{body * 2}</div><footer>foot</footer>") == f"{text}\n\n{text}"
        assert html_text.main_text(f"<div {wrapper}><p>tiny</p></div>") == "tiny"
        assert html_text.main_text(f"{body}<div {wrapper}>{body * 3}</div>") == text
    assert html_text.main_text(f'{body * 2}<div class="post-comments">{body}</div>') == f"{text}\n\n{text}"
    assert html_text.main_text(f'<p title="a<b>c">{text}</p>') == text
    for broken in ("<a ", "<script ", "<!", "<?", '<a "', "<a '", '<a "<a "', "</a", "<!--", '<p class="'):
        began = time.perf_counter()
        html_text.main_text(broken * (1_000_000 // len(broken)))
        assert time.perf_counter() - began < 5, broken


def test_html_without_marked_elements():
    text = "a line of running text that is long enough " * 3
    text = text.strip()
    body = f"<p>{text}</p>"
    links = "".join(f'<li><a href="{i}">link number {i}</a></li>' for i in range(6))
    assert html_text.main_text(f"<div><h1>Head</h1><p>short</p>{body}</div>") == f"Head\n\nshort\n\n{text}"
    assert html_text.main_text(f"<div><h1>Site</h1></div><ul>{links}</ul><div><div><h2>Head</h2><div>{body}</div></div></div>") == f"Head\n\n{text}"  # links part the site's name
    assert html_text.main_text(f"<section><div>{body}</div></section><section><div><p>last</p></div></section>") == f"{text}\n\nlast"  # nesting is no dive
    assert html_text.main_text(f"{body}<ul>{links}</ul><p>after</p>") == text
    assert html_text.main_text(f"<article><header><h1>Head</h1><p>by someone</p><a href=1>share</a></header>{body}</article>") == f"Head\n\n{text}"
    assert html_text.main_text(f"<header><h1>Site</h1></header><div>{body}</div>") == text
    assert html_text.main_text(f"<h2>Open {body}") == f"Open\n\n{text}"


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_html_pages_do_not_need_the_article_element(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet").select("html").collect()]
    renamed = [re.sub(r"(?i)<(/?)(article|main)\b", r"<\1div", p or "") for p in pages]
    assert [html_text.main_text(p) for p in renamed] == [html_text.main_text(p or "") for p in pages]


def test_html_rows(spark):
    rows = [(1, "u", None, "t", 0), (2, None, "", "t", 0), (None, "u", "<p>some words", "t", 0), (3, "u", "<p>same", "t", 0), (3, "u", "<p>same", "t", 0), (4, "u", "<p>" + "é " * 500_000, "t", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = collections.Counter((r.page_id, r.url, r.text[:5], r.n_chars) for r in html_text.extract_main_text(df).collect())
    assert got == collections.Counter({(1, "u", "", 0): 1, (2, None, "", 0): 1, (None, "u", "some ", 10): 1, (3, "u", "same", 4): 2, (4, "u", "é é é", 999_999): 1})
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_html_line_blocks_decide_on_marked_pages():
    body = "<p>" + "long text " * 20 + "</p>"
    text = ("long text " * 20).strip()
    links = "<ul>" + "".join(f"<li><a href={i}>an older entry {i}</a></li>" for i in range(9)) + "</ul>"
    assert html_text.main_text(f"<article><h1>Head</h1>{body}<p>x</p>{links}</article>") == f"Head\n\n{text}\n\nx"  # dive
    assert html_text.main_text(f"<article><p>on top</p>{links}<h1>Head</h1>{body}</article>") == f"Head\n\n{text}"  # surge
    cards = "".join(f"<article><h2>card {i}</h2><p>a teaser</p></article>" for i in range(3))
    assert html_text.main_text(f"<div>{body * 3}</div>{cards}") == "\n\n".join([text] * 3)
    assert html_text.main_text(f"<p>{'outside ' * 12}</p><main>{body}</main>") == text


def test_language_sums_all_segmentations():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba"]
    v = language.Vocabulary(pieces)
    p = np.array([[0.3], [0.2], [0.25], [0.15], [0.1]])
    word = np.frombuffer(b"ababa", np.uint8)

    def total(s):
        return 1.0 if not s else sum(p[pieces.index(x), 0] * total(s[len(x) :]) for x in pieces if s.startswith(x))

    lattice = language.Lattice(word, np.array([0]), np.array([5]), v)
    assert np.isclose(np.exp(lattice.log_total(lattice.forward(p)))[0, 0], total(b"ababa"))
    uses = lattice.expected(p, np.ones((1, 1)))[:, 0]
    assert np.isclose(sum(u * len(x) for u, x in zip(uses, pieces)), 5)


def test_language_long_words_and_pieces():
    rng = random.Random(5)
    pieces = [b"a", b"b", b"ab", b"bba", b"ababbabbabbabbababab"]
    p = np.array([[1e-4, 0.3], [1e-3, 0.2], [1e-5, 0.3], [0.2, 0.1], [0.1, 0.1]])
    words_ = [bytes(rng.choices(b"ab", k=n)) for n in (3, 200, 1000)] + [pieces[4] * 11, b"ab"]
    data = np.frombuffer(b"".join(words_), np.uint8)
    size = np.array([len(w) for w in words_])
    ends, found, uses = np.cumsum(size), np.zeros((len(words_), 2)), 0
    v = language.Vocabulary(pieces)
    for g in language._word_groups(size):
        lattice = language.Lattice(data, (ends - size)[g], ends[g], v)
        found[g] = lattice.log_total(lattice.forward(p))
        uses = uses + lattice.expected(p, np.ones((len(g), 2)))
    for w, got in zip(words_, found):
        for lang in range(2):
            alpha = [fractions.Fraction(1)]
            for i in range(1, len(w) + 1):
                alpha.append(sum((alpha[i - len(x)] * fractions.Fraction(p[k, lang]) for k, x in enumerate(pieces) if w[:i].endswith(x)), fractions.Fraction(0)))
            assert np.isclose(got[lang], math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator))
    assert np.allclose((uses * np.array([len(x) for x in pieces])[:, None]).sum(axis=0), size.sum())


def test_language_held_out_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit_language_model(docs.where("doc_id % 2 = 0"))
    found = language.identify_language(docs.where("doc_id % 2 = 1"), model, keep=["lang"])
    assert found.where("lang = lang_pred").count() > 0.98 * found.count()
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify_language(edge_docs(spark, [(30, "123 !? ·")]), model).collect()}
    assert got[1] == got[2] == got[6] == got[30] == ("und", 0.0) and got[5][0] != "und"
    assert language.identify_language(edge_docs(spark), language.fit_language_model(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_cross_entropy(spark):
    a = [(i, "the quick brown fox. " * 5) for i in range(20)]
    b = [(100 + i, "&&& %%% 123 zzz. " * 5) for i in range(20)]
    docs = spark.createDataFrame([*a, *b, (200, None), (201, "")], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(20)] + [(None,)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(docs, ids).collect()}
    assert got[3].ce_difference < 0 < got[105].ce_difference and got[200].n_tokens == 0 and got[201].ce_target is None
    none = lm_score.cross_entropy_difference(docs.limit(0), ids)
    assert none.count() == 0 and none.columns == ["doc_id", "n_tokens", "ce_target", "ce_background", "ce_difference"]


@pytest.mark.parametrize(("hot", "buckets", "ids"), [(4, 64, 5), (1 << 17, 1 << 22, 1000), (1 << 17, 32, 1000)])
def test_cross_entropy_word_brute_force(spark, hot, buckets, ids):
    rng = random.Random(3)
    vocabulary = ["the", "of", "1234", "5678", "мир", "мур", "漢字", "漢語", "Fox.", "x"]
    rows = [(i, " ".join(rng.choices(vocabulary, range(10, 0, -1), k=rng.randint(0, 30)))) for i in range(60)]
    rows += [(7, rows[7][1]), (None, "the мир"), (None, "the мир"), (90, None), (91, " \n"), (92, "5678 the")]
    good = set(range(0, 60, 3))
    got = lm_score.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("t", F.lit(2)), spark.createDataFrame([(i,) for i in good], "doc_id long"), hot=hot, bucket_grams=buckets, broadcast_ids=ids).collect()
    tokens = [(i, [*w, ""] if (w := (t or "").lower().split()) else []) for i, t in rows]
    models = []
    for keep in (lambda i: i in good, lambda i: True):
        one, two = collections.Counter(), collections.Counter()
        for i, w in tokens:
            if keep(i):
                one.update(w)
                two.update(zip(["", *w], w))
        models.append((one, two))
    v, s = models[1][0].total(), lm_score.STRENGTH
    expected = []
    for i, w in tokens:
        ce = [-sum(np.log2((one[b] + s / v) / (one.total() + s)) + np.log2((two[a, b] + s / v) / (one[a] + s)) for a, b in zip(["", *w], w)) / 2 / len(w) if w else None for one, two in models]
        expected.append((i, len(w), *ce))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert len(got) == len(rows)
    for g, e in zip(sorted(got, key=key), sorted(expected, key=key)):
        assert tuple(g[:2]) == e[:2] and (g[2] is e[2] is None or np.allclose([g[2], g[3], g[4]], [e[2], e[3], e[2] - e[3]]))


def test_top_k_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:120] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (None, [1.0] * 8), (903, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in top_k.top_k(df, df.where("vec_id % 50 = 0"), shard_rows=60, query_rows=3, leaf=8).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    q = np.floor(256 * x.astype(float))
    for i in range(0, 400, 50):
        s = q @ q[i]
        assert got[i] == sorted(((int(s[j]), j) for j in range(400) if j != i), key=lambda t: (-t[0], t[1]))[:5]
    assert set(got) == set(range(0, 400, 50))
    assert top_k.top_k(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows, ahead", [(16, 1), (64, 4), (5000, 4)])
def test_top_k_routes_copies_lengths_and_repeated_rows(spark, shard_rows, ahead):
    rng = np.random.default_rng(5)
    centres = 6 * rng.normal(size=(7, 6))
    vectors = [(i, (centres[i % 7] + rng.normal(size=6)).astype(np.float32)) for i in range(500)]
    vectors += [(i, vectors[3][1]) for i in range(500, 800)]  # a third are copies
    vectors += [(1000 + i, rng.normal(size=1 + i % 12).astype(np.float32)) for i in range(240)]  # more lengths than routes are made for
    vectors += [vectors[10], vectors[10]]
    rows = [(i, [float(x) for x in v], 1, "v", 0.5) for i, v in vectors]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int, v string, floor double")
    got = collections.defaultdict(list)
    for r in top_k.top_k(df, df.where("vec_id % 10 = 0"), shard_rows=shard_rows, query_rows=7, leaf=8, ahead=ahead).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    q = {i: np.floor(256 * v.astype(float)) for i, v in vectors}
    for i in q:
        if i % 10 == 0:
            expected = sorted(((int(q[i] @ q[j]), j) for j, v in vectors if j != i and len(v) == len(q[i])), key=lambda t: (-t[0], t[1]))[:5]
            assert got.pop(i) == expected
    assert not got


def test_top_k_branches_are_passed_over(monkeypatch):
    """On parted clusters a query looks at few leaves, and the result is whole."""
    rng = np.random.default_rng(6)
    x = np.floor(256 * np.repeat(40 * rng.normal(size=(20, 5)), 50, axis=0) + 256 * rng.normal(size=(1000, 5)))
    q, seen = x[::50], []
    reach = top_k._reach
    monkeypatch.setattr(top_k, "_reach", lambda a, c, r: seen.append(len(a) * len(r)) or reach(a, c, r))
    best, who = top_k.search(x, np.arange(1000), q, np.arange(0, 1000, 50), np.full(20, top_k.LOW), 5, 8)
    nodes = len(top_k.BallTree(x, 8).radii)
    assert sum(seen) < 0.5 * nodes * len(q)
    for n in range(20):
        s = x @ q[n]
        assert [(-int(b), int(w)) for b, w in zip(best[n], who[n])] == sorted((-int(s[j]), j) for j in range(1000) if j != 50 * n)[:5]


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 30), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan_mix(df).collect()
    sizes = collections.Counter()
    taken, target = collections.Counter(), {}
    for r, (_, _, s) in zip(sorted(got, key=lambda r: r.doc_id), rows):
        assert r.size == rows[r.doc_id][1].count("w") and r.taken <= 3 * r.size and r.taken == r.size * len(r.draws)
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    assert all(abs(taken[s] - target[s]) <= 30 for s in target) and abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    again = mixing.plan_mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken, r.draws) for r in got) == sorted((r.doc_id, r.taken, r.draws) for r in again)
    assert mixing.water_fill([10, 1000], [2, 1], 3) == [30.0, 980.0]
    q = mixing.split_quotas(np.array([17, 0, 400]), 6, 1)
    assert q.sum(axis=0).tolist() == [17, 0, 400] and q.sum(axis=1).max() - q.sum(axis=1).min() <= 2
    order = mixing.write_order(mixing.plan_mix(df))
    assert order.count() == sum(len(r.draws) for r in got)
    assert mixing.plan_mix(edge_docs(spark)).count() == 9 and mixing.plan_mix(df.limit(0)).count() == 0


def test_token_counts(spark, tmp_path):
    rng = np.random.default_rng(4)
    lengths = [0, 3, 0, 50, 1, 7, 200, 0]
    flat = np.concatenate([np.append(rng.integers(0, 1000, n), 50256) for n in lengths] + [np.arange(5)]).astype("<u2")
    flat.tofile(tmp_path / "a.bin")
    np.array([], "<u2").tofile(tmp_path / "b.bin")
    (tmp_path / "c.bin").write_bytes(b"\x01\x00\x07")
    assert token_counts.read_token_files(spark, f"file://{tmp_path}/c.bin").first().tokens == b"\x01\x00"
    (tmp_path / "c.bin").unlink()
    blocks = token_counts.read_token_files(spark, f"file://{tmp_path}", block_tokens=16)
    assert blocks.where("octet_length(tokens) > 32").count() == 0
    got = sorted((r.ordinal, r.n_tokens, r.closed) for r in token_counts.count_tokens(blocks).collect())
    assert got == [(i, n, True) for i, n in enumerate(lengths)] + [(8, 5, False)]
    docs = edge_docs(spark)
    got = collections.Counter((r.doc_id, r.n_tokens) for r in token_counts.document_tokens(docs, block_tokens=64).collect())
    assert got[1, 0] == got[2, 0] == 1 and got[3, 3] == 2 and got[4, 3] == got[None, 3] == 1 and sum(got.values()) == 9
    assert token_counts.document_tokens(docs.limit(0)).count() == 0
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.DEFAULT_RANKS, "rb"))}
    e = tiktoken.Encoding("t", pat_str=token_counts._SPLIT, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in entries.op10_separator_scan(spark, SF).collect()}
    assert got == {i: len(e.encode_ordinary(t or "")) for i, t in texts.items()}


def test_secret_query_brute_force(spark):
    """op2's base columns by the plain reading of the patterns."""
    for r in entries.op2_secret_scan(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        spans = []
        for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r.text or "", re.A):
            spans += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] if len(m[2]) >= 6 else []
        for k, (name, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
            spans += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, r.text or "") if len(m[0]) >= least]
        assert r.base_sha256 == hashlib.sha256(",".join(s for _, _, s in sorted(spans)).encode()).hexdigest()


def test_pipeline(spark):
    import corpus_pipeline as cp

    out = cp.run(spark, SF)
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.decontaminate(docs, bench).where("contaminated").collect()}
    assert kept and not kept & bad
    groups = groups_of([(r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text or "")])
    assert all(groups[i][1] == i for i in kept)
    assert out.where("text rlike 'AKIA[A-Z0-9]{16,}'").count() == 0
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(3, same), (5, "quite another text of its own"), (5, same), (5, same), (None, same), (7, "the token: abcdef1 and more words here"), (8, None)]
    few = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], docs.schema)
    got = [(r.doc_id, r.text) for r in cp.one_of_each(spark, few, SF).collect()]
    assert collections.Counter(got) == collections.Counter([(3, same), rows[1], rows[5], rows[6]])
    item = bench.first().text
    leaked = spark.createDataFrame([(5, item, None, None, 0), (5, "clean words", None, None, 0), (None, None, None, None, 0)], docs.schema)
    assert {r.text for r in cp.not_in_benchmark(spark, leaked, SF).collect()} == {"clean words", None}
    assert {r.text for r in cp.without_secrets(spark, few, SF).collect()} >= {"the [REDACTED] and more words here", None}
    assert cp.mixed(spark, docs.limit(0), SF).count() == 0
    empty = docs.limit(0)
    for _, stage in cp.STAGES[:-1]:
        empty = stage(spark, empty, SF)
        assert empty.columns == cp.COLUMNS and empty.count() == 0
    assert shared_dir(spark)


def test_top_k_is_exact_for_large_products(spark):
    rng = np.random.default_rng(8)
    v = rng.integers(-(2**21), 2**21, (40, 3)).astype(float)
    v[1::2] = v[::2]
    v[1::2, 2] += 2.0**-8  # products that differ beyond 53 bits
    v[:2] = [[2.0**31, 1, 1], [2.0**30, 1, 1]]  # the first is too long, the second is not too long for itself
    v[:2, 0] /= 256
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k.top_k(d, d.where("vec_id % 4 = 1")).collect())
    whole = [[math.floor(256 * x) for x in row] for row in v.tolist()]
    fits = [i for i in range(40) if sum(x * x for x in whole[i]) < 2**62]
    want = []
    for i in (i for i in fits if i % 4 == 1):
        scores = sorted((-sum(a * b for a, b in zip(whole[i], whole[j])), j) for j in fits if j != i)[:5]
        want += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores, 1)]
    assert got == sorted(want) and 0 not in fits and 1 in fits and max(abs(r[3]) for r in got) > 2**53


def test_rows_meet_their_decision_by_id_where_hashes_collide(spark, monkeypatch):
    words = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)]
    rows = [(i, words[i // 2] + (" more" if i % 4 == 1 else ""), i % 3) for i in range(80)] + [(None, words[0], 1), (None, words[39], 2), (7, words[30], 0), (200, words[5], 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n int")
    want = sorted(map(str, near_duplicates.without_near_duplicates(d).collect()))
    monkeypatch.setattr(near_duplicates, "_row_hash", lambda id_col, text_col: F.pmod(F.xxhash64(text_col), F.lit(3)))
    assert sorted(map(str, near_duplicates.without_near_duplicates(d).collect())) == want
