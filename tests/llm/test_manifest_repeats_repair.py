"""Merkle manifest, substring dedup and conversation repair against plain versions that hold everything in memory."""

import hashlib
import random
import re
import zlib

import pytest

from docflow.llm import common, conversations, manifest, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEP = " \t\n\x0b\x0c\r"
by = lambda rows: sorted(map(tuple, rows), key=lambda x: tuple(map(repr, x)))


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes):
    """The root, and each leaf's (left, right) siblings by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            b = i // 3 * 3
            run = nodes[b : b + 3]
            ways[k].append(("".join(run[: i - b]), "".join(run[i - b + 1 :])))
            at[k] = i // 3
        nodes = [digest(*nodes[b : b + 3]) for b in range(0, len(nodes), 3)]
    return nodes[0], ways


def plain_manifest(rows):
    leaf = lambda r, t: digest(*map(value, (r[0], r[3], r[2], r[4], t)))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names, trees = sorted(groups, key=lambda s: (s is not None, (s or "").encode())), {}
    for s in names:
        mine = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = (mine, *plain_tree([leaf(r, r[1]) for r in mine]))
    root, ways = plain_tree([trees[s][1] for s in names])
    for s, up in zip(names, ways, strict=True):
        mine, subroot, own = trees[s]
        for r, way in zip(mine, own, strict=True):
            odd = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 2
            acc = leaf(r, r[1] if odd or r[1] is None else r[1].replace("\n", ""))
            for a, b in way + up:
                acc = digest(a, acc, b)
            yield r[0], leaf(r, r[1]), subroot, root, digest(*(a + b for a, b in way + up)), acc, acc == root


DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string"


@pytest.mark.parametrize("sizes", [[1], [1, 1], [4, 1, 2], [243, 244, 10, 1, 1], [800, 3]])
def test_manifest_of_trees_of_many_shapes(spark, sizes):
    rows = [(i * 7 % 1000, f"text {i}\nline" if i % 3 else None, "en", None if s == 1 else f"s{s}é", i if i % 5 else None, "own", "tree") for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = manifest.verified(docs, manifest.tampered()).collect()
    assert by(got) == by(plain_manifest(rows))


def test_manifest_of_odd_rows(docs, texts, empty):
    assert by(manifest.verified(docs, manifest.tampered()).collect()) == by(plain_manifest(texts))
    assert manifest.verified(empty, manifest.tampered()).collect() == []


def test_nodes_cover_what_their_children_cover(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 2}", 1, "", "") for i in range(1200)]
    made = manifest.build(spark.createDataFrame(rows, DOCS).select("source", "doc_id", manifest.leaf("text").alias("leaf")), "source", "doc_id")
    nodes = {(r.tree, r.level, r.lo): r for r in made.nodes().collect()}
    for (tree, level, lo), node in nodes.items():
        if level:
            kids = [nodes[tree, level - 1, lo + k * 3 ** (level - 1)] for k in range(3) if lo + k * 3 ** (level - 1) < node.hi]
            assert kids[0].lo == lo and kids[-1].hi == node.hi and node.digest == digest(*(k.digest for k in kids))
    assert {(r.tree, r.subroot) for r in made.roots().collect()} == {(t, n.digest) for (t, _, _), n in nodes.items() if (n.lo, n.hi) == (0, 600)}


def test_ranks_of_groups_over_many_partitions(spark):
    rows = [("a", i) for i in range(500)] + [(None, i) for i in range(300)] + [(f"g{i}", 0) for i in range(40)] + [("z", None), ("z", 1), ("z", 1)]
    got = common.ranked(spark.createDataFrame(rows, "g string, v long").repartition(7), ["g"], ["v"]).collect()
    assert sorted(((r.g or "", r.rank) for r in got)) == sorted([("a", i) for i in range(500)] + [("", i) for i in range(300)] + [(f"g{i}", 0) for i in range(40)] + [("z", i) for i in range(3)])
    assert all(r.v == r["rank"] for r in got if r.g in ("a", None))


def plain_repeats(rows, width):
    first, words = {}, [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - width + 1 if d is not None else 0):
            first[tuple(w[i : i + width])] = min(first.get(tuple(w[i : i + width]), d), d)
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - width + 1 if d is not None else 0):
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        yield d, len(w), len(gone), digest(" ".join(x for i, x in enumerate(w) if i not in gone))


@pytest.mark.parametrize("width", [1, 2, 7, 50])
def test_every_repeated_window_goes(docs, texts, width):
    assert by(substrings.digests(docs, width=width).collect()) == by(plain_repeats([t[:2] for t in texts], width))


def test_passages_that_touch_overlap_and_nest(spark):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(200)]
    rows = []
    for d in range(120):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            a, n, at = rng.randint(0, 150), rng.choice([49, 50, 51, 80, 120]), rng.randint(0, len(words))
            words[at:at] = passage[a : a + n]
        rows.append((rng.randint(0, 100), rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(200 + i, "a " * 300) for i in range(3)] + [(150, "a\n" * 120), (None, " ".join(passage))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = by(plain_repeats(rows, 50))
    assert by(substrings.digests(docs).collect()) == want and sum(w[2] for w in want) > 3000
    runs = substrings.repeats(docs).collect()
    assert all(b.first > a.last for r in runs for a, b in zip(r.runs, r.runs[1:], strict=False))  # maximal: none touch
    assert sum(x.last - x.first for r in runs for x in r.runs) == sum(w[2] for w in want)


def test_keys_that_most_rows_have_are_joined_by_broadcast(docs, texts, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    assert by(substrings.digests(docs, width=2).collect()) == by(plain_repeats([t[:2] for t in texts], 2))


def test_no_documents_no_repeats(empty):
    assert substrings.digests(empty).collect() == []


def plain_damage(rows):
    for c, t, r, x in rows:
        c_, t_, r, x = (" " if v is None else str(v) for v in (c, t, r, x))
        k = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        for _ in range(0 if k == 0 else 2 if k == 3 else 1):
            yield c, t, "user" if k == 4 else r, x


def plain_repair(rows):
    """By a program over (state) that keeps the least (cost, audit) and the repaired rows as text."""
    groups = {c: [] for c, *_ in rows}
    for r in plain_damage(rows):
        groups[r[0]].append(r)
    following = lambda s: (3, "assistant") if s == 2 else (2, "user")
    for c, mine in groups.items():
        mine = sorted(mine, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, n, best = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, {0: (0, "", ())}

        def put(to, s, found):
            if s not in to or found[:2] < to[s][:2]:
                to[s] = found
                return True

        def inserts(best):
            while any([put(best, following(s)[0], (k + 5, a + "I", (*o, f"{following(s)[1]}:"))) for s, (k, a, o) in list(best.items())]):  # noqa: C419
                pass

        for _, _, r, x in mine:
            y = x.strip(SEP)
            fault = "blank" if not y else "duplicate" if (r, x) in seen else "truncated" if y[-1] not in ".!?" else None
            seen.add((r, x))
            inserts(best)
            new = {}
            for s, (k, a, o) in best.items():
                put(new, s, (k + 2, a + "D", o))
                if fault in (None, "truncated"):
                    k += 5 * (fault is not None)
                    put(new, following(s)[0], (k + 1, a + "R", (*o, f"{following(s)[1]}:{x}")))
                    to = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(r[:1])
                    if to:
                        put(new, to, (k, a + "K", (*o, f"{r}:{x}")))
            if fault:
                n[fault] += 1
            best = new
        inserts(best)
        cost, audit, out = min(best[s] for s in (0, 3) if s in best)
        heads = [r[2][:1] for r in mine]
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        yield c, gaps, *n.values(), sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False)), cost, audit, digest("\n".join(out))


TALK = "conv_id long, turn long, role string, text string, pos long, audit string, seq string"


def talk(seed, most):
    rng = random.Random(seed)
    rows = []
    for c in range(50):
        for t in range(rng.choice([1, 2, 3, 5, 9, most])):
            role = rng.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"])
            rows.append((c or None, rng.choice([t, t, t, None, t + 2]), role, rng.choice(["hi.", "ok? \n", "x", "", " \t", None, f"t{t}.", f"n{t}", "ünï!"]), 5, "KKK", "x"))
    return rows


@pytest.mark.parametrize(("segment", "rules"), [(256, 128), (4, 3), (2, 0)])
def test_least_edits_of_every_conversation(spark, monkeypatch, segment, rules):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    monkeypatch.setattr(conversations, "SEGMENTS", 3)
    whole = conversations.grammar
    monkeypatch.setattr(conversations, "grammar", lambda texts: whole(texts, rules))
    rows = talk(segment, 40)
    df = spark.createDataFrame(rows, TALK).repartition(3)
    done = conversations.repair(conversations.damaged(df))
    assert by(conversations.summary(df, done).collect()) == by(plain_repair([r[:4] for r in rows]))


def test_repaired_rows_have_the_form_and_the_digest(spark):
    df = spark.createDataFrame(talk(9, 20), TALK)
    done = conversations.repair(conversations.damaged(df))
    texts, heads = {}, {}
    for r in sorted(done.repaired().collect(), key=lambda r: r.place):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        heads[r.conv_id] = heads.get(r.conv_id, "") + r.role[0]
    assert all(re.fullmatch("s?(ua)+", h) for h in heads.values()) and len(heads) > 20
    assert all(digest("\n".join(texts.get(r.conv_id, []))) == r.repaired_sha256 for r in done.digests().collect())


def test_a_rules_matrix_is_the_product_of_its_symbols():
    one, two, three = "", "", ""
    known = conversations.matrices([("ua", one), (one + one, two), ("x" + two, three)])
    plain = known["x"]
    for c in "uaua":
        plain = conversations.product(plain, known[c])
    assert [w and (w.cost, w.audit) for w in plain] == [w and (w.cost, w.audit) for w in known[three]]
    assert known[three][3].audit == "DKKKK"


def test_no_conversations(spark):
    df = spark.createDataFrame([], TALK)
    assert conversations.summary(df, conversations.repair(conversations.damaged(df))).collect() == []
