"""Operators that bring documents together: copies, joins, lines, shards, archives, mixes."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sahifa.llm import exact_dedup, line_dedup, mixing, ngram_join, sharding, union_find, warc
from sahifa.llm.ranks import ordered_sums


def normal(text):
    return (text or "").encode().lower()


def test_exact_groups_equal_brute_force(documents, clashing, no_documents):
    rows = documents.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[normal(r["text"])].append(r["doc_id"])
    expected = collections.Counter()
    for r in rows:
        ids = [i for i in groups[normal(r["text"])] if i is not None]
        keep = max(ids) if ids else None
        expected[r["doc_id"], keep, len(groups[normal(r["text"])]), r["doc_id"] == keep, hashlib.sha256(normal(r["text"])).hexdigest()] += 1
    for df, budget in ((documents, exact_dedup.BUDGET), (clashing, 2000)):
        got = exact_dedup.exact_groups(df, budget=budget).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert collections.Counter(map(tuple, got)) == expected
    assert exact_dedup.exact_groups(no_documents).count() == 0


@pytest.mark.parametrize("budget", [1 << 30, 500])
def test_trie_holds_what_a_dict_holds(budget):
    rng, trie, known = random.Random(budget), exact_dedup.SpillingTrie(exact_dedup.chooser("smallest"), budget), {}
    for i in range(3000):
        key = bytes(rng.choices(b"ab", k=rng.choice((0, 1, 5, 9)))) + b"x" * rng.choice((0, 40))
        known[key] = (min(known.get(key, (i, 0))[0], i), known.get(key, (0, 0))[1] + 1)
        trie.add(key, i, 1)
    found = list(trie.items())
    assert {k: (o, n) for k, o, n in found} == known and len(found) == len(known)


def shingles(text):
    w = normal(text).split()
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def connected(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_components_equal_brute_force(documents, clashing, no_documents):
    rows = [r for r in documents.collect() if r["doc_id"] is not None]
    sets = [(r["doc_id"], shingles(r["text"])) for r in rows]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    of = connected({i for i, _ in sets}, links)
    expected = collections.Counter((i, len(s), of[i]) for i, s in sets)
    for df in (documents, clashing):
        got = [tuple(r) for r in ngram_join.near_components(df).collect()]
        assert collections.Counter(g for g in got if g[0] is not None) == expected and len(got) == df.count()
    assert ngram_join.near_components(no_documents).count() == 0
    kept = [r["doc_id"] for r in ngram_join.drop_near_copies(documents).collect() if r["doc_id"] is not None]
    assert set(kept) == set(of.values())


def test_a_large_group_of_near_copies(spark):
    """Copies of copies, each with some words changed, so that many are similar to some of the group only."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = [base] + [[w if rng.random() > p else f"x{i}_{k}" for k, w in enumerate(base)] for i, p in enumerate(rng.choices((0.005, 0.01, 0.02, 0.03, 0.05), k=250))]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [(i, shingles(t)) for i, t in rows]
    of = connected(range(len(rows)), [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if 100 * len(x & y) >= 80 * len(x | y)])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == of


def test_lists_in_parts_lose_no_link(spark, monkeypatch):
    """Groups of few near copies whose lists are cut: a partner may be in another part."""
    monkeypatch.setattr(ngram_join, "PART", 2)
    rng, texts = random.Random(21), []
    for g in range(40):
        base = [f"g{g}_{k}" for k in range(80)]
        texts += [" ".join(w if k != rng.randrange(80) else f"x{len(texts)}_{i}" for k, w in enumerate(base)) for i in range(2 + g % 6)]
    rows = list(enumerate(texts))
    sets = [(i, shingles(t)) for i, t in rows]
    of = connected(range(len(rows)), [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if 100 * len(x & y) >= 80 * len(x | y)])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == of and len(set(of.values())) < len(of)


def test_all_pairs_of_a_hot_list_lose_no_link(spark, monkeypatch):
    """No round of leaders but the first; lists are dealt to many tasks and pairs taken in the first list that has them."""
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    monkeypatch.setattr(ngram_join, "ROWS", 3)
    monkeypatch.setattr(ngram_join, "PART", 1)
    rng, texts = random.Random(22), []
    passage = [f"p{k}" for k in range(60)]
    for g in range(50):
        base = passage + [f"g{g}_{k}" for k in range(rng.choice((0, 8, 12, 20)))]
        texts += [" ".join(w if rng.random() > 0.015 else f"x{len(texts)}_{i}_{k}" for k, w in enumerate(base)) for i in range(3)]
    rows = list(enumerate(texts))
    sets = [(i, shingles(t)) for i, t in rows]
    of = connected(range(len(rows)), [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if 100 * len(x & y) >= 80 * len(x | y)])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == of and 1 < len(set(of.values())) < len(of)


def test_one_row_of_equal_sets_stays(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcd")
    rows = [(1, a), (1, a), (1, a.upper()), (None, a), (None, a), (None, b), (None, b), (2, c), (3, c), (4, c), (4, d), (None, None), (None, None), (5, ""), (5, "")]
    left = ngram_join.drop_near_copies(spark.createDataFrame(rows, "key long, text string"), "key").collect()
    got = collections.Counter((r["key"], (r["text"] or "").lower()) for r in left)
    # 4 is one document of two texts, one of them a copy.
    assert got == {(1, a): 1, (None, b): 1, (2, c): 1, (None, ""): 2, (5, ""): 2}


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 62, rng.integers(4, 900)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.2], rng.integers(0, 1 << 62, 20).astype(np.uint64)]))
        a, b = ngram_join.parities(x), ngram_join.parities(y)
        while len(a) != len(b):
            a, b = (a, b[: len(b) // 2] ^ b[len(b) // 2 :]) if len(b) > len(a) else (a[: len(a) // 2] ^ a[len(a) // 2 :], b)
        assert sum(int(v).bit_count() for v in (a ^ b).view(np.uint64)) <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)], [(5, 2), (2, 5), (9, 7), (None, 3)]])
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in union_find.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None]
    assert got == connected({n for link in real for n in link}, real)


def test_similar_lines_stay_once(spark):
    rng = random.Random(6)
    line = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(30))
    near = line.replace(line.split()[3], "changed", 1)
    rows = [(1, f"{line}\nown one here"), (2, f"{near}\n\nown two there, which is long"), (3, line.upper()), (4, None), (5, ""), (6, "own one here\nown one here"), (6, "own one here\nown one here"), (None, "a line without an identifier")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("dropped", F.lit(2))
    got = {(r["_id"], r["n_lines"], r["n_kept"], tuple(r["dropped"])) for r in line_dedup.line_verdicts(df).collect()}
    assert got == {(1, 2, 2, ()), (2, 2, 1, (0,)), (3, 1, 0, (0,)), (4, 0, 0, ()), (5, 0, 0, ()), (6, 2, 0, (0, 1)), (None, 1, 1, ())}
    left = line_dedup.dedup_lines(df)
    assert left.columns == df.columns and {(r["doc_id"], r["text"]) for r in left.collect()} == {(1, rows[0][1]), (2, "\nown two there, which is long"), (4, None), (5, ""), (None, rows[7][1])}


def test_lines_equal_brute_force(documents, no_documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.filter("doc_id is not null").collect()]
    lines = sorted({x for _, t in docs for x in (y.strip(line_dedup.SPACE_CHARS).lower() for y in (t or "").split("\n")) if x})
    sets = [(x, frozenset(x[k : k + 5] for k in range(max(1, len(x) - 4)))) for x in lines]
    of = connected(lines, [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if 100 * len(x & y) >= 80 * len(x | y)])
    kept = sum(r["n_kept"] for r in line_dedup.line_verdicts(documents.filter("doc_id is not null")).collect())
    # Banding may miss a link between lines that are hardly similar enough.
    assert len(set(of.values())) <= kept <= 1.02 * len(set(of.values())) + 1
    assert line_dedup.line_verdicts(no_documents).count() == 0


def similar_lines(lines):
    sets = [(x, frozenset(x[k : k + 5] for k in range(max(1, len(x) - 4)))) for x in lines]
    return [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if 100 * len(x & y) >= 80 * len(x | y)]


def test_chains_and_short_lines_are_merged(spark):
    """Families whose lines change step by step, so that most are similar to some of the family only, and six-word lines."""
    rng, lines = random.Random(17), []
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    for _ in range(12):
        now = [letters(6) for _ in range(30)]
        for _ in range(40):
            now = [letters(6) if k == rng.randrange(30) else w for k, w in enumerate(now)]
            lines.append(" ".join(now))
    for _ in range(150):
        short = [letters(rng.choice((4, 5, 6, 7))) for _ in range(6)]
        lines += [" ".join(short), " ".join(short)[:-1] + "q", "z" + " ".join(short)]
    lines = sorted(set(lines))
    possible = len(lines) - len(set(connected(lines, similar_lines(lines)).values()))
    made = len(lines) - lines_kept(spark, lines)
    assert 0.97 * possible <= made <= possible


def test_large_buckets_lose_nothing(spark, monkeypatch):
    """Bitmaps decide where a bucket is not small; here every bucket is large."""
    monkeypatch.setattr(line_dedup, "SMALL", 0)
    monkeypatch.setattr(line_dedup, "SHARE", 7)
    rng = random.Random(18)
    base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(40)]
    lines = sorted({" ".join(w if rng.random() > 0.05 else f"x{i}{k}" for k, w in enumerate(base)) for i in range(150)})
    possible = len(lines) - len(set(connected(lines, similar_lines(lines)).values()))
    assert 0.97 * possible <= len(lines) - lines_kept(spark, lines) <= possible


def test_lines_with_bitmaps_are_as_many_as_lines_in_pairs(spark, monkeypatch):
    """Not those of buckets that have grown large only, or their number would jump from none to all as a family grows."""
    seen, presence = [], line_dedup.presence
    monkeypatch.setattr(line_dedup, "presence", lambda texts: seen.append(texts.count()) or presence(texts))
    rng = random.Random(19)
    base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(40)]
    lines = [" ".join(f"x{i}" if k == i % 40 else w for k, w in enumerate(base)) for i in range(100)]
    assert lines_kept(spark, lines[:20]) == lines_kept(spark, lines) == 1
    assert seen == [20, 100]


def test_signatures_and_bitmaps_are_of_all_shingles(spark):
    """Rows of several shingles lose none, whatever is left over for the last row, and lines that are similar may pass."""
    rng = random.Random(20)
    letters = lambda n: "".join(rng.choices("abcdeé\U0001f600", k=n))
    lines = [letters(n) for n in (*range(1, 40), 3000)]
    df = spark.createDataFrame(list(enumerate(lines)), "h long, line string")
    pieces = [(h, x[k : k + 5]) for h, x in enumerate(lines) for k in range(max(1, len(x) - 4))]
    hashed = spark.createDataFrame(pieces, "h long, s string").select("h", F.hash(F.encode("s", "UTF-32")).alias("x"), F.xxhash64(F.encode("s", "UTF-32")).alias("y")).collect()
    sig, cells, counts = {}, {}, collections.Counter(r["h"] for r in hashed)
    for r in hashed:
        sig[r["h"]] = list(map(min, sig.get(r["h"], [1 << 31] * line_dedup.VALUES), (r["x"] ^ m for m in line_dedup.XORS)))
        cells.setdefault(r["h"], set()).add(((r["y"] >> 6) % line_dedup.WORDS, r["y"] % 64))
    for r in line_dedup.signatures(df).collect():
        assert r["sig"] == sig[r["h"]] and r["few"] == sum((v & 3) << 2 * k for k, v in enumerate(sig[r["h"]]))
    for r in line_dedup.presence(df).collect():
        assert r["n"] == counts[r["h"]] and {(k, b) for k, w in enumerate(r["bits"]) for b in range(64) if w >> b & 1} == cells[r["h"]]


def lines_kept(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return sum(r["n_kept"] for r in line_dedup.line_verdicts(df).collect())


def test_lines_of_one_template_find_their_twins(spark):
    """All share so much that buckets are large, and each is similar enough to its twin only."""
    rng = random.Random(14)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    template, lines = " ".join(letters(6) for _ in range(16)), []
    for _ in range(300):
        own = " ".join(letters(6) for _ in range(5))
        lines += [f"{template} {own}", f"{template} {own[:-2]}{letters(2)}"]
    of = connected(lines, similar_lines(lines))
    assert len(set(of.values())) == 300 and lines_kept(spark, lines) <= 303


def test_bands_find_pairs_that_are_just_similar(spark):
    """Pairs of a similarity of 0.8 to 0.86, of words with and without vowels in front."""
    rng, lines = random.Random(15), []
    for k in range(400):
        words_ = ["".join(rng.choices("aeiou" if k % 2 and not j else "bcdfghklmnprst", k=1)[0] for j in range(6)) for _ in range(30)]
        line = " ".join(words_)
        while True:
            other = list(line)
            for at in rng.sample(range(len(line)), rng.choice((3, 4, 5))):
                other[at] = "x"
            x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (line, "".join(other)))
            if 0.8 <= len(x & y) / len(x | y) < 0.86:
                break
        lines += [line, "".join(other)]
    assert lines_kept(spark, lines) <= 400 * 1.015


def test_lines_without_spaces_are_told_by_all_shingles(spark):
    """An edit at the front of a long line of lower-case letters, and short lines with an edit at the end."""
    rng, lines = random.Random(16), []
    for _ in range(40):
        line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200))
        lines += [line, "QQ" + line[2:]]
        short = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=30))
        lines += [short, short + "z"]
    assert lines_kept(spark, lines) <= 81


def test_hilbert_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        index = sharding.hilbert_index(cells, bits)
        assert sorted(index) == list(range(len(cells))) and (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_and_slots_gapless(spark, documents, clashing, no_documents, tmp_path):
    for df in (documents, clashing):
        rows = sharding.shard(df, 7).collect()
        per = collections.defaultdict(list)
        for r in rows:
            per[r["shard"]].append(r["slot"])
        assert len(rows) == df.count() and set(per) <= set(range(7)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in per.values())
    data = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in documents.collect())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == data
    assert sharding.shard(no_documents).count() == 0
    unique = documents.filter("doc_id < 60").dropDuplicates(["doc_id"])
    sharding.write_shards(unique, str(tmp_path / "s"), 3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == unique.count()


def test_ordered_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "c"]), i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {r["k"]: r["s"] for r in ordered_sums(df, ["g", "k"], "v", "g", "s").collect()}
    total = collections.Counter()
    for g, k, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        total[g] += v
        assert got[k] == total[g]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records(version):
    name, url, block = "x.arc", warc.escaped("http://a b/é\n%20"), b"HTTP/1.1 200 OK\r\n\r\nbody\n\nof lines"
    data = warc.arc_begin(version, name) + warc.arc_record(version, name, 0, url, block) + warc.arc_record(version, name, 9, url, b"")
    (at, head, first), (_, _, second) = warc.arc_records(data)
    assert data[at:].startswith(url.encode())
    assert first == block and second == b"" and warc.unescaped(head[0]) == "http://a b/é\n%20" and len(head) == (5 if version == 1 else 10)
    with pytest.raises(ValueError, match="version block"):
        list(warc.arc_records(b"http://a 1 2 3 4\n"))
    with pytest.raises(ValueError, match="beyond the end"):
        list(warc.arc_records((warc.arc_begin(version, name) + warc.arc_record(version, name, 0, url, block))[:-5]))


def test_archives_round_trip(spark):
    page = "<p>" + "é" * 60 + "\r\n\r\n</p>"
    rows = [(3, "u3", page), (1, "u1", page), (2, "u2", page), (4, None, None), (5, "", ""), (6, "http://x y", "short"), (7, "u7", "short"), (8, "u", "WARC/1.1\r\n\r\nContent-Length: 5" * 9), (None, "n", "q" * 200), (1, "u1", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("payload", F.lit(2))
    got = collections.Counter(tuple(r) for r in warc.round_trip(df).collect())
    expected = collections.Counter()
    for i, url, text in rows:
        payload = (text or "").encode()
        repeat = text == page and i != 1
        expected[i, url, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if repeat else "response", 1 if repeat else None] += 1
    assert got == expected
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("most", [0, 100])
def test_archives_of_other_makers(spark, tmp_path, monkeypatch, version, most):
    """No page identifiers, a URL in Latin-1, records without an HTTP head, odd identifiers; revisits refer by record."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    rest = "" if version == 1 else "200 abc - 77 f.arc "
    line = lambda url, date, kind, n: f"{url} 10.0.0.1 {date} {kind} {rest}{n}\n".encode("latin-1")
    body, http = b"<p>" + b"same payload " * 20 + b"</p>", b"HTTP/1.0 200 OK\r\nServer: \xe9\r\n\r\n"
    block = f"{version} 0 Other\n{warc.FIELDS[version]}\n\n".encode()
    data = f"filedesc://f.arc 0.0.0.0 19990101000000 text/plain {'' if version == 1 else '200 - - 0 f.arc '}{len(block)}\n".encode() + block + b"\n"
    records = [("http://a/\xe9", "19990103000000", http + body), ("http://b/", "19990102000000", http + body), ("dns:x", "19990104000000", b"10.0.0.1"), ("http://c/", "19990105000000", b"HTTP/1.0 200 OK\r\nX-Page-Id: none\r\n\r\n" + body)]
    for url, date, content in records:
        data += line(url, date, "text/html", len(content)) + content + b"\n"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "part-0.arc").write_bytes(data)
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = {r["url"]: r for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert len(got) == 4 and got["http://b/"]["record_type"] == "response" and got["dns:x"]["record_type"] == "resource"
    first = got["http://b/"]["record_id"]
    for url in ("http://a/\ufffd", "http://c/"):
        r = got[url]
        assert (r["record_type"], r["refers_to_id"], r["payload_bytes"], r["payload_digest"]) == ("revisit", first, len(body), hashlib.sha256(body).hexdigest())
    assert all(r["page_id"] is None for r in got.values()) and got["http://b/"]["date"] == "1999-01-02T00:00:00Z"


def test_mix_shares_and_limits(documents, clashing, no_documents):
    for df in (documents, clashing):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
        size, taken, target, most = (collections.Counter() for _ in range(4))
        for r in rows:
            size[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
            most[r["source"]] = max(most[r["source"]], r["size"])
        assert sum(taken.values()) <= sum(size.values()) and abs(sum(target.values()) - sum(size.values())) < 1e-6 * sum(size.values())
        assert all(abs(taken[s] - target[s]) <= 2 * max(most.values()) and target[s] <= 3 * size[s] + 1e-6 for s in size)
        assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(df).collect()))
    assert mixing.mix(no_documents).count() == 0
    applied = mixing.apply_mix(documents)
    assert applied.columns == documents.columns
    words = lambda t: len((t or "").encode().split())
    assert sum(words(r["text"]) for r in applied.select("text").collect()) == sum(r["taken"] for r in mixing.mix(documents).collect())


def test_mix_keeps_rows_that_repeat_apart(spark):
    """Null and empty texts and whole rows that repeat: one result each, and none taken more than three times."""
    rows = [(1, "a b c", "x")] * 5 + [(None, None, "x")] * 3 + [(2, "", None)] * 4 + [(3, "d e", None), (4, " ".join(["w"] * 60), "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df).collect()
    expected = collections.Counter((i, len((t or "").split()), s) for i, t, s in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["source"]) for r in mixed) == expected and all(0 <= r["copies"] <= 3 for r in mixed)
    copies, applied = collections.Counter(), collections.Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.apply_mix(df).collect())
    for r in mixed:
        copies[r["doc_id"], r["size"]] += r["copies"]
    assert {(i, len((t or "").split())): n for (i, t, _), n in applied.items()} == {k: n for k, n in copies.items() if n}


def test_targets_stop_and_reshare(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got["a"] == 30 and abs(got["b"] - (2010 - 30) * 2 / 3) < 1e-9 and abs(got["c"] - (2010 - 30) / 3) < 1e-9 and got[None] == 0
