"""Fingerprints of versions, repair of conversations and runs of words, against brute force and on odd tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridimpact.llm import conversation_repair as repair
from gridimpact.llm import fingerprints as prints
from gridimpact.llm import periodic_runs as runs
from gridimpact.llm.queries import QUERIES

# --- fingerprints -----------------------------------------------------------------------------------------------------


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def share(a: str, b: str) -> float:
    x, y = set(prints.paragraphs(a)), set(prints.paragraphs(b))
    return len(x & y) / len(x | y) if x | y else 1.0


def brute_versions(texts: list[str]) -> list[tuple]:
    """n_chars, digest of the edited text and both likenesses of texts in descending order of their identifiers."""
    out = []
    for t, u in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        out.append((len(t), sha(e), share(t, e), share(t, u)))
    return out


def test_tables_tell_what_differs_or_that_too_much_does():
    rng = random.Random(1)
    draw = lambda n: np.array(sorted({rng.getrandbits(64) for _ in range(n)}), np.uint64)
    common = draw(500)
    a, b = np.union1d(common, draw(2)), np.union1d(common, draw(3))
    one, other = prints.fingerprints_of([a, b])
    left, right = prints.differing(one, other)
    assert sorted(left) == sorted(set(a.tolist()) - set(b.tolist())) and sorted(right) == sorted(set(b.tolist()) - set(a.tolist()))
    assert prints.differing(*prints.fingerprints_of([draw(400), draw(300)])) is None
    assert prints.differing(one, one) == ([], [])
    pool = [draw(n) for n in (0, 0, 1, 7, 40, 300, 4000)]
    pairs = [(np.union1d(x, common[: rng.randint(0, 60)]), np.union1d(y, common[: rng.randint(0, 60)])) for x in pool for y in pool] + [(pool[0], pool[1])]
    for cells in (1, prints.CELLS):  # one cell in a group: most must be tried again with more
        for (x, y), got in zip(pairs, prints.likeness(pairs, cells), strict=True):
            p, q = set(x.tolist()), set(y.tolist())
            assert got == (len(p & q) / len(p | q) if p | q else 1.0)
    clash = np.array([1, 1 | 1 << 60], np.uint64)  # these share all cells, whatever the size
    assert prints.likeness([(clash, clash[:0])], 1).tolist() == [0.0]


def test_paragraphs_are_the_same_wherever_they_stand():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeg") for _ in range(rng.randint(1, 9)))
    long = " ".join(word() for _ in range(3000))
    assert " ".join(prints.paragraphs(long)) == long and len(prints.paragraphs(long)) > 100
    assert len(set(prints.paragraphs(long)) - set(prints.paragraphs("xyz " + long))) <= 2
    assert prints.paragraphs("One. Two!  Three\n\n \t\nfour 1.5 五。六") == ["One.", "Two!", "Three", "four 1.5 五。六"]


@pytest.mark.parametrize("partitions", [1, 9])
def test_successors_of_odd_rows(spark, partitions):
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(rng.randint(1, 12))) + "."
    lines = [line() for _ in range(60)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 20))) for _ in range(70)] + ["", None, "  \n", "é" * 5000, "one two. " * 4000, "🙂👍"]
    rows = [(i, t, i, "x") for i, t in enumerate(texts)] + [(None, "no id", 0, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, fingerprint string").repartition(partitions)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = {r[0]: w for r, w in zip(ordered, brute_versions([r[1] or "" for r in ordered]), strict=True)}
    out = prints.with_successors(df).collect()
    assert len(out) == len(rows) and {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in out} == want
    own = {r.doc_id: r.fingerprint for r in prints.fingerprints(df).collect()}
    assert {r.doc_id: r.fingerprint for r in out} == own
    assert prints.with_successors(df.where("false")).count() == 0 and prints.fingerprints(df.where("false")).count() == 0


def test_repeated_identifiers_and_a_single_document(spark):
    one = prints.with_successors(spark.createDataFrame([(5, "abcd. efg")], "doc_id long, text string")).collect()
    assert [(r.n_chars, r.edited_sha256, r.near_next) for r in one] == [(9, sha("abcd." + "abcd"), 1.0)]
    df = spark.createDataFrame([(7, "same. text here")] * 300 + [(k, f"other {k}.") for k in range(20)], "doc_id long, text string").repartition(6)
    out = prints.with_successors(df).collect()
    assert len(out) == 320 and len({r.fingerprint for r in out if r.doc_id == 7 and r.n_chars == 15}) == 1
    assert sum(r.near_next == 1.0 and r.doc_id == 7 for r in out) == 299


# --- conversations ----------------------------------------------------------------------------------------------------

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FULL = {"u": "user", "a": "assistant"}


def brute_damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def brute_faults(turns: list[tuple]) -> str:
    out, seen = "", set()
    for _, _, role, text in turns:
        bare = text.strip(" \t\n\r\x0b\x0c")
        out += "b" if not bare else "d" if (role, text) in seen else "k" if bare[-1] in ".!?" else "t"
        seen.add((role, text))
    return out


def brute_repair(turns: list[tuple]) -> tuple[int, str, list]:
    """Cost, audit and the roles given, from the last turn to the first: the best way on from each role that may have come before."""
    faults = brute_faults(turns)

    def with_insertions(ways: dict) -> dict:
        for _ in range(3):
            for before, role in itertools.product(list(ways), "ua"):
                after = ways.get(NEXT.get((before, role)))
                if after:
                    way = (after[0] + 3, "I" + after[1], [(role, None), *after[2]])
                    ways[before] = min(way, ways[before], key=lambda w: w[:2]) if ways[before] else way
        return ways

    ways = with_insertions({"": (0, "", []), "s": None, "u": None, "a": (0, "", [])})
    for i in range(len(turns) - 1, -1, -1):
        found = {}
        for before in ways:
            more, own, options = 3 * (faults[i] == "t"), turns[i][2][:1], []
            moves = [(before, 4, "D", [])]
            if faults[i] in "kt":
                moves += [(NEXT.get((before, own)), more, "K", [("K", i)])] + [(NEXT.get((before, r)), 3 + more, "R", [(r, i)]) for r in "ua"]
            for after, cost, letter, kept in moves:
                if after is not None and ways[after]:
                    options.append((ways[after][0] + cost, letter + ways[after][1], kept + ways[after][2]))
            found[before] = min(options, key=lambda w: w[:2]) if options else None
        ways = with_insertions(found)
    return ways[""]


def exhaustive_repair(turns: list[tuple]) -> tuple[int, str]:
    faults, best = brute_faults(turns), (10**6, "")
    gaps = ["", *"ua", *(a + b for a in "ua" for b in "ua")]
    choices = [[("D", 4, "")] + ([("K", 3 * (f == "t"), t[2][:1] or "?")] + [("R", 3 + 3 * (f == "t"), r) for r in "ua"] if f in "kt" else []) for t, f in zip(turns, faults, strict=True)]
    for edits in itertools.product(*choices):
        for put in itertools.product(gaps, repeat=len(turns) + 1):
            roles = put[0] + "".join(e[2] + p for e, p in zip(edits, put[1:], strict=True))
            if re.fullmatch("(s?(ua)+)?", roles):
                way = sum(e[1] for e in edits) + 3 * sum(map(len, put)), "I" * len(put[0]) + "".join(e[0] + "I" * len(p) for e, p in zip(edits, put[1:], strict=True))
                best = min(best, way)
    return best


def brute_report(rows: list[tuple]) -> dict:
    turns = defaultdict(list)
    for r in brute_damage(rows):
        turns[r[0]].append(r)
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted(turns[c], key=lambda r: (r[1] is not None, r[1] or 0))
        cost, audit, given = brute_repair(own)
        faults, roles, numbers = brute_faults(own), [r[2][:1] for r in own], [r[1] for r in own if r[1] is not None]
        lines = [f"{FULL[r]}:" if i is None else f"{own[i][2] if r == 'K' else FULL[r]}:{own[i][3]}" for r, i in given]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        out[c] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, sha("\n".join(lines)))
    return out


def odd_conversations() -> list[tuple]:
    rng, rows = random.Random(3), []
    for c in [None, *range(40)]:
        size, turn = (150 if c in (7, None) else rng.choice([0, 1, 2, 3, 8, 30])), 0
        for k in range(size):
            turn += rng.choice([1, 1, 1, 1, 3])
            text = rng.choice(["", "Hi.", "no end", "A. b", "x!", "  ", "é?\n", "end ."]) + ("" if rng.random() < 0.3 else f"{rng.randrange(99)}.")
            rows.append((c, None if k == 0 and rng.random() < 0.2 else turn, rng.choice(["user", "assistant", "system", "user", "assistant", None, "tool", ""]), None if rng.random() < 0.05 else text))
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_cheapest_repair_is_that_of_all():
    rng = random.Random(8)
    for _ in range(40):
        turns = [(1, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["", "Hi.", "no end", "Hi.", "x!"])) for i in range(rng.randint(0, 3))]
        assert brute_repair(turns)[:2] == exhaustive_repair(turns)


@pytest.mark.parametrize("size", [256, 3, 1])
def test_conversations_of_many_segments(spark, size):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS + ", audit string, kind int").repartition(5)
    out = repair.repaired(repair.damaged(df), present_col="present", size=size).collect()
    assert {r.conv_id: tuple(r)[1:] for r in out} == brute_report(rows) and len(out) == len({r[0] for r in rows})


def test_conversations_of_the_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.01").collect()} == brute_report(rows)


def test_odd_conversations(spark):
    make = lambda rows: spark.createDataFrame(rows, CONVERSATIONS)
    assert repair.repaired(make([])).count() == 0 and repair.repaired(repair.damaged(make([])), present_col="present").count() == 0
    gone = make([(1, 0, "user", "a."), (1, None, None, None)]).selectExpr("*", "false AS here")
    assert [tuple(r) for r in repair.repaired(gone, present_col="here").collect()] == [(1, 0, 0, 0, 0, 0, 0, "", sha(""))]
    same = [(5, 2, "user", "Hi.")] * 200 + [(5, 1, "user", "long " * 50_000 + "."), (5, 2, "assistant", "Yes.")]
    out = repair.repaired(make(same).repartition(4), size=16).collect()
    # At turn 2 the assistant comes before the user; of the equal turns one stays, and an assistant is put in at the end.
    assert [tuple(r)[:-1] for r in out] == [(5, 0, 0, 199, 0, 199, 199 * 4 + 3, "KKK" + "D" * 199 + "I")]
    nulls = repair.repaired(make([(None, None, None, None)] * 3)).collect()
    assert [tuple(r) for r in nulls] == [(None, 0, 3, 0, 0, 2, 12, "DDD", sha(""))]


# --- runs -------------------------------------------------------------------------------------------------------------


def brute_runs(words: list, least: int = 6, times: int = 4) -> list[tuple]:
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q) and not any(all(words[x] == words[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(words: list[bytes]) -> tuple:
    found = brute_runs(words)
    best = min(found, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2])) if found else (None, None, None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return len(found), *best, 1000 * best[1] // best[2] if found else None, sha(listed), hashlib.sha256(kept).hexdigest()


def repeating(rng: random.Random, most: int) -> list[bytes]:
    letters = rng.choice([1, 2, 2, 3, 6])
    words = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(0, most))]
    for _ in range(rng.randint(0, 3)):
        at, part = rng.randint(0, len(words)), [b"%d" % rng.randrange(letters) for _ in range(rng.randint(1, 7))]
        words[at:at] = (part * rng.randint(2, 9))[: rng.randint(4, 40)]
    return words


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(800):
        texts = [repeating(rng, 60), [b"x"], repeating(rng, 12)]
        for words, parts in zip(texts, runs.stretches(texts, 4), strict=True):
            assert runs.runs_of(words, parts) == brute_runs(words), words
            assert runs.runs_of(words, [(0, len(words))]) == brute_runs(words), words  # what is cut out beforehand changes nothing


def test_suffix_tree_has_all_suffixes_and_links():
    rng = random.Random(2)
    for _ in range(60):
        s = [rng.randrange(3) for _ in range(rng.randint(0, 50))] + [-1]
        tree = runs.SuffixTree(s)
        assert sorted(tree.leaves) == list(range(len(s)))
        text = lambda u: s[tree.first[u] : tree.first[u] + tree.depth[u]]  # noqa: B023, E731
        for u in range(1, len(tree.begin)):
            inner = bool(tree.kids[u])
            assert len(tree.kids[u]) != 1 and tree.first[u] == min(tree.leaves[tree.low[u] : tree.high[u]])
            if inner:
                assert text(tree.link[u]) == text(u)[1:]
        seen, at = 0, 0
        for i, j in tree.blocks():
            assert i == at
            earlier = lambda n: any(s[k : k + n] == s[i : i + n] for k in range(i))  # noqa: B023, E731
            assert j - i == 1 or earlier(j - i)
            assert j == len(s) or not earlier(j - i + 1)
            at, seen = j, seen + 1
        assert at == len(s)


def test_long_texts_take_time_in_proportion():
    import time

    for words in ([b"a"] * 60_000, [b"a", b"b"] * 30_000, [b"%d" % (k % 7001) for k in range(60_000)]):
        start = time.time()
        assert runs.runs_of(words, runs.stretches([words], 4)[0]) == [(0, 60_000, len(set(words)))]
        assert time.time() - start < 20


def test_runs_of_odd_rows(spark):
    rng = random.Random(5)
    texts = [b" ".join(repeating(rng, 60)).decode() for _ in range(80)] + ["", None, " \t\n", "é é é é é é é é", "a\x0bb\x0cc", "one " * 9 + "two", "x" * 50_000, "😀 " * 7]
    rows = [(i, t, "x", 3) for i, t in enumerate(texts)] + [(None, "z z z z z z", "y", 1), (3, texts[3], "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, collapsed string, start long").repartition(3)
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    want = Counter((r[0], *brute_digest(words(r[1]))) for r in rows)
    assert Counter(tuple(r) for r in runs.runs_digest(df).collect()) == want
    for r in runs.periodic_runs(df).collect():
        assert [tuple(x) for x in r.runs] == brute_runs(words(texts[r.doc_id] if r.doc_id is not None else rows[-2][1]))
    assert runs.runs_digest(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="four periods"):
        runs.periodic_runs(df, times=2)


def test_planted_words():
    for i in range(400):
        words = [b"%d" % k for k in range(i % 37)]
        h, n = zlib.crc32(str(i).encode()), len(words)
        want = list(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
        assert runs.planted(i, words) == want


def test_queries_return_the_agreed_columns(spark):
    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id", ascending=False).collect()
    out = QUERIES["op11_fingerprints"](spark, folder)
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    want = {d.doc_id: w for d, w in zip(documents, brute_versions([d.text or "" for d in documents]), strict=True)}
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in out.collect()} == want
    out = QUERIES["op13_periodic_runs"](spark, folder)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = {(d.doc_id, *brute_digest(runs.planted(d.doc_id, runs.words_of(d.text or "")))) for d in documents}
    assert {tuple(r) for r in out.collect()} == want
