import hashlib
import random

from leadflow.llm import chat, merkle, url_lists

PARTS = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/END]", "<", "[", "a", "/", "]", ">", "\n", "S"]


def test_template_reads_back():
    rng = random.Random(1)
    for _ in range(20_000):
        turns = [(rng.choice(["user", "assistant", "system", "", "tool", "[/ROLE]\\"]), "".join(rng.choice(PARTS) for _ in range(rng.randrange(8))))
                 for _ in range(rng.randrange(4))]
        text, spans = chat.format_turns(turns)
        assert chat.parse_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_best_paths_of_a_tree(spark):
    #        1 - 2 - 3        scores choose 1-4-6, then 1-4-5, then 1-2-3
    #         \- 4 - 5 | 6    9 and 8 are a cycle, 7 has a parent that is not there
    rows = [("t", 1, None, 1.0), ("t", 2, 1, 0.0), ("t", 3, 2, None), ("t", 4, 1, 2.0), ("t", 5, 4, 1.0), ("t", 6, 4, 5.0),
            ("t", 7, 77, 9.0), ("t", 8, 9, 1.0), ("t", 9, 8, 1.0), ("u", 1, None, 0.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    out = {}
    for r in chat.reply_paths(df, keep=4).collect():
        out.setdefault((r.tree, r["rank"]), []).append((r.place, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in out.items()} == \
        {("t", 1): [7], ("t", 2): [1, 4, 6], ("t", 3): [1, 4, 5], ("t", 4): [1, 2, 3], ("u", 1): [1]}
    assert chat.reply_paths(df.limit(0)).count() == 0


def test_conversations_read_back(spark):
    long = "x</s>" * 20_000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 2, None, None), (2, 5, "assistant", "b"), (2, 5, "assistant", "a"),
            (2, 5, "assistant", "a"), (None, 0, "user", "no id"), (3, None, "tool", ""), *[(4, i, "assistant", f"t{i}") for i in range(70)]]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, node string, tree int")
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    text = {r.tree: r.formatted for r in formatted.collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (
            len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == len(text[chat._NO_ID if c is None else c])
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_url_lists_as_of(spark):
    entries = spark.createDataFrame(
        [("a.com", 10, "block"), ("a.com", 50, "allow"), ("a.com/x", 40, "review"), ("a.com", 10, "allow"), (None, 1, "block"), ("b.com", None, "block")],
        "key string, day int, action string")
    captures = spark.createDataFrame(
        [(1, "http://A.com/y", 9, "e"), (2, "https://u@a.com:80/y?z", 10, "e"), (3, "http://a.com/x/1", 45, "e"), (4, "http://a.com/y", 400, "e"),
         (5, None, 20, "e"), (6, "not a url", 20, "e"), (7, "http://b.com/", 20, "e"), (8, "http://a.com/x", None, "e"), (9, "http://a.com", 49, "e"),
         (10, "http://a.com", 49, "e")], "capture_id long, url string, day int, key string")
    got = {r.capture_id: (r.action, r.list_key, r.listed_on) for r in url_lists.judge(captures, entries).collect()}
    none = ("none", None, None)
    assert got == {1: none, 2: ("block", "a.com", 10), 3: ("review", "a.com/x", 40), 4: ("allow", "a.com", 50), 5: none, 6: none, 7: none,
                   8: none, 9: ("block", "a.com", 10), 10: ("block", "a.com", 10)}
    assert url_lists.judge(captures.limit(0), entries).count() == 0
    assert {r.action for r in url_lists.judge(captures, entries.limit(0)).collect()} == {"none"}


def test_fingerprints_locate_edits():
    rng = random.Random(2)
    text = "\n".join(" ".join(f"w{rng.randrange(9999)}" for _ in range(50)) for _ in range(40))
    changed = text[:5000] + "CHANGED" + text[5010:]
    a, b, same = merkle.fingerprints([text, changed, text])
    assert a == same and a[:32] != b[:32] and merkle.likeness(a, a) == 1.0
    assert merkle.likeness(a, b) > 0.95 and merkle.likeness(a, b) == merkle.likeness(b, a)
    where = merkle.edits(a, b)
    assert 1 <= len(where) <= 3 and len({(s, p) for s, p, _ in where}) == 1 and not merkle.edits(a, a)
    empty, other = merkle.fingerprints(["", "other words entirely"])
    assert merkle.likeness(empty, empty) == 1.0 and merkle.likeness(empty, other) == 0.0 == merkle.likeness(a, other)
    assert merkle.fingerprints(["", ""]) == [empty, empty]
    assert len({f[:32] for f in merkle.fingerprints(["a", "a ", "a\n", "\na", " a", "a b", "b a"])}) == 7


def test_fingerprint_report(spark, docs):
    rng = random.Random(3)
    rows = [(i * 3 % 1009, " ".join(rng.choice("abé") * 4 for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(9000, None), (9001, ""), (9002, "é" * 200_000), (8, "tie b"), (8, "tie a"), (None, "no id")]
    out = merkle.fingerprint_report(docs([(i, t, "s") for i, t in rows])).collect()
    ordered = sorted(((i is not None, i or 0, (t or "")) for i, t in rows), key=lambda r: (not r[0], -r[1], r[2].encode()))
    want = []
    for k, (known, i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][2]
        n = len(t) // 3
        e = t[:len(t) - n] + after[:n]
        f, g, h = merkle.fingerprints([t, e, after])
        want.append((i if known else None, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, merkle.likeness(f, g), merkle.likeness(f, h)))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert merkle.fingerprint_report(docs([(1, "a", "s")]).limit(0)).count() == 0
    one = merkle.fingerprint_report(docs([(1, "abcdef", "s")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
