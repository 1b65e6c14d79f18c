"""Operators on single texts: quality rules, extraction, encoding, secrets."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest

from sahifa.llm import bpe, dom, html_extract, quality_rules, secrets
from sahifa.llm.boosting import BoostedTrees

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")


def measured(text):
    w = WORD.findall(text or "")
    windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = set()
    for k in range(len(w) - 4):
        if windows[tuple(w[k : k + 5])] > 1:
            covered.update(range(k, k + 5))
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(documents, clashing):
    for df in (documents, clashing):
        got = quality_rules.assess(df, carry=("doc_id", "text")).collect()
        assert len(got) == df.count()
        for r in got:
            m = tuple(r[c] for c in quality_rules.MEASURES)
            assert m == measured(r["text"])
            assert r["base_failed"] == (m[0] < 10 or 100 * m[4] > 20 * m[0]) and not (r["base_failed"] and r["kept"])


def test_rules_separate_good_from_bad(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(n)).capitalize() + "."
    rows = [(i, " ".join(prose(12) for _ in range(6)), 1) for i in range(300)]
    rows += [(1000 + i, re.sub(r"(\w+)", r"\1###", " ".join(prose(12) for _ in range(6))), 0) for i in range(20)] + [(2000 + i, " ".join(prose(12) for _ in range(6)).upper(), 0) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, good int")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.assess(df).collect()}
    assert sum(got[i] == bool(good) for i, _, good in rows) >= 0.98 * len(rows) and all(got[i] for i in range(300))


def test_quality_of_nothing(no_documents):
    assert quality_rules.assess(no_documents).count() == 0 and quality_rules.filter_quality(no_documents).columns == no_documents.columns


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_tokens_equal_the_library(documents, clashing, no_documents, library):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for df in (documents, clashing):
        for r in bpe.token_digest(df, PATH).collect():
            ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids if r["doc_id"] is not None else None
            if ids is not None:
                decoded = library.decode(ids, skip_special_tokens=False)
                assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert bpe.token_digest(no_documents, PATH).count() == 0
    ids = bpe.encode(documents.filter("doc_id = 9003"), PATH)
    assert bpe.decode(ids, PATH).first()["decoded"] == "one</w> two</w>"


def test_odd_texts_equal_the_library(library):
    mine, rng = bpe.WordBpe(open(PATH, encoding="utf-8").read()), random.Random(1)
    pools = ["aeth", "aAbB 'sStTlL.!?0129ΣσςİıKſé́e  \x1c\x85​ ﻿", "".join(map(chr, range(0x250))), "".join(chr(c) for c in range(0x300, 0x3000, 7))]
    for _ in range(3000):
        text = "".join(rng.choices(rng.choice(pools), k=rng.randint(0, 60))) + rng.choice(("", "", "<|endoftext|>", "<|startoftext|>x<|END"))
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids and mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def base_of(text):
    """The three patterns, as they are stated."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found)]


def test_secrets_equal_brute_force(spark, documents, clashing, no_documents):
    for df in (documents, clashing):
        texts = collections.Counter(r["text"] for r in df.collect())
        assert sum(texts.values()) == secrets.secret_digest(df).count()
    rows = secrets.secret_digest(documents.filter("doc_id >= 9000")).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in documents.filter("doc_id >= 9000").collect()}
    for r in rows:
        expected = base_of(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest() and set(expected) <= set(r["spans"].split(","))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(e.startswith(k) for e in expected) for k in ("assign", "access", "hex"))
    assert secrets.secret_digest(no_documents).count() == 0


def test_constants_are_followed(spark):
    text = 'KEY = "Zx9Qw8Er7Ty6"\nother = KEY\nclient_password = other\nname = "Zx9Qw8Er7Ty7"'
    assert [text[s:e] for s, e in secrets.lexed(text)] == ["Zx9Qw8Er7Ty6"]
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert secrets.redact(df).orderBy("doc_id").first()["text"].startswith('KEY = "[secret]"')
    assert secrets.find_secrets(df).orderBy("doc_id").first()["spans"][0]["kind"] == "lexed"
    assert secrets.lexed("a = b\nb = a\npassword = a") == []


def test_extraction_on_held_out_pages():
    rng, model = random.Random(99), html_extract.trained()
    right = wrong = missed = 0
    for _ in range(60):
        nodes, x, y = html_extract.training_page(rng)
        if nodes:
            for node, is_article, chosen in zip(nodes, y, html_extract.decode(nodes, model.log_odds(x)), strict=True):
                if node.tag == "#text":
                    n = len(node.text)
                    right, wrong, missed = right + n * (is_article and chosen), wrong + n * (chosen and not is_article), missed + n * (is_article and not chosen)
    assert right / (right + wrong) > 0.96 and right / (right + missed) > 0.96


def test_extraction_of_pages(spark):
    page = "<html><body><nav><ul><li><a href=1>Home page</a></li><li><a href=2>News</a></li></ul></nav><div class='ad'>Buy this now. It is good.</div><article><h1>A title of a text</h1><p><b>First &amp; best line\nof the text.<br><p>Second paragraph, which is long enough to be read by people.</article><footer>&copy; someone</footer></body></html>"
    rows = [(1, "u", page, 5), (2, None, None, 5), (3, "v", "", 5), (None, "w", "<<<p", 5), (1, "u", page, 5)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    expected = "A title of a text\n\nFirst & best line of the text.\n\nSecond paragraph, which is long enough to be read by people."
    assert sorted((r["text"], r["n_chars"]) for r in got if r["page_id"] == 1) == [(expected, len(expected))] * 2
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in got if r["page_id"] in (2, 3)) and len(got) == 5
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_decoding_keeps_article_below_article():
    rng = np.random.default_rng(4)
    nodes, _ = html_extract.features(html_extract.parse("<div><p>a</p><div><p>b</p><ul><li>c</li><li>d</li></ul></div></div><p>e</p>"))
    for _ in range(50):
        chosen = dict(zip(map(id, nodes), html_extract.decode(nodes, rng.normal(size=len(nodes))), strict=True))
        assert all(chosen.get(id(n.parent), True) for n in nodes if chosen[id(n)])


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = BoostedTrees(rounds=30).fit(x[:1500], y[:1500])
    assert ((model.log_odds(x[1500:]) > 0) == (y[1500:] > 0.5)).mean() > 0.9


def test_unclosed_unseen_elements_keep_what_follows():
    seen = lambda page: [n.text for n in dom.ordered(dom.parse(page)) if n.tag == "#text"]
    assert seen("<html><head><title>t</title><meta charset=x><p>one</p><p>two</p>") == ["one", "two"]
    assert seen("<head><script>a<p>b</script>words<p>one") == ["words", "one"]
    for tag in "canvas object video audio svg math noscript template".split():
        assert seen(f"<p>one</p><{tag} x=y><p>two</p>") == ["one", "two"]
        assert seen(f"<p>one</p><{tag}>gone</{tag}><p>two</p>") == ["one", "two"]
    assert seen("<p>one</p><script>gone<p>two</p>") == ["one"]


def test_a_long_chain_of_names_is_followed():
    lines = ['k0 = "Zx9Qw8Er7Ty6"', *(f"k{i + 1} = k{i}" for i in range(40)), "password = k40"]
    assert [(s, e) for s, e in secrets.lexed("\n".join(lines))] == [(6, 18)]
    assert secrets.lexed("a = b\nb = a\nc = a\na = c\npassword = a") == []


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('K = "Zx9Qw8Er7Ty6"; A = K; K = "hello-world-abc"; client_passphrase = A', ["Zx9Qw8Er7Ty6"]),
        ('client_passphrase = K\nK = "Zx9Qw8Er7Ty6"', ["Zx9Qw8Er7Ty6"]),
        ('auth_key = """Zx9Qw8Er7Ty6"""', ["Zx9Qw8Er7Ty6"]),
        ("auth_key = '''Zx9\nQw8Er7Ty6'''", ["Zx9\nQw8Er7Ty6"]),
        ("<db_passphrase>Zx9Qw8Er7Ty6</db_passphrase>", ["Zx9Qw8Er7Ty6"]),
        ('signing_key = "Zx9Qw8" + "Er7Ty6aa"', ['Zx9Qw8" + "Er7Ty6aa']),
        ('signing_key: str = "Zx9Qw8Er7Ty6aa"', ["Zx9Qw8Er7Ty6aa"]),
        ("cfg['auth_credential'] = rb'Zx9Qw8Er7Ty6'", ["Zx9Qw8Er7Ty6"]),
        ('{"credentials": "Zx9Qw8Er7Ty6", "x": 1}', ["Zx9Qw8Er7Ty6"]),
        ("it's 5\" disk: don't  client_passphrase = 'Zx9Qw8Er7Ty6'", ["Zx9Qw8Er7Ty6"]),
        ("client_passphrase = name\nother = 'Zx9Qw8Er7Ty6'", []),
        ("client_passphrase = <your value>", []),
    ],
)
def test_source_and_configuration_syntax(text, found):
    assert [text[s:e] for s, e in secrets.lexed(text)] == found


def test_long_chains_before_and_after_their_literal():
    links = [f"c{i + 1} = c{i}" for i in range(100)]
    for lines in (["c0 = 'Zx9Qw8Er7Ty6'", *links, "client_passphrase = c100"], ["client_passphrase = c100", *reversed(links), "c0 = 'Zx9Qw8Er7Ty6'"]):
        text = "\n".join(lines)
        assert [text[s:e] for s, e in secrets.lexed(text)] == ["Zx9Qw8Er7Ty6"]


@pytest.mark.parametrize("text", ["x=" + "a" * 1_000_000, "a-" * 300_000 + "=b", 'x = "' + '\\"' * 300_000, "<a>" * 200_000 + "=", "x:" * 200_000, "'''" + "a:" * 200_000])
def test_very_long_lines_take_their_share(text):
    began = time.perf_counter()
    secrets.scan(text)
    assert time.perf_counter() - began < 5
