import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from terraflow.llm import decontaminate, jaccard, line_templates

BENCH = "item_id long, text string, n long"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contaminated(rows, items, width=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = defaultdict(set)
    for item, text in items:
        w = cut(text)
        n = min(len(w), width)
        for i in range(len(w) - n + 1) if w else ():
            windows[tuple(w[i : i + n])].add(str(item) if item is not None else "null")
    out = []
    for doc, text in rows:
        w, hit, found = cut(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= names
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.fixture(scope="module")
def items(rows):
    piece = lambda k, a, b: " ".join(rows[k][1].split()[a:b])
    return [
        (1, piece(5, 3, 40)), (2, piece(3, 10, 22).upper()), (3, piece(8, 0, 6)), (4, "nothing like this stands in any text of the table at all"),
        (5, None), (6, ""), (None, piece(9, 1, 13)), (7, piece(5, 20, 50)), (7, piece(5, 20, 50)), (8, "one"), (9, "...!"), (10, piece(20, 4, 30) + ", extra words at the end that differ"),
    ]


def test_contamination(spark, docs, rows, items, empty):
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], BENCH)
    got = decontaminate.contamination(docs, bench).drop("__k1", "__k2")
    assert Counter(map(tuple, got.collect())) == contaminated(rows, items)
    nothing = spark.createDataFrame([], BENCH)
    assert decontaminate.contamination(docs, nothing).filter("contaminated").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    dirty = {r[0] for r in contaminated(rows, items) if r[5]}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if i not in dirty)


def test_letters_beyond_ascii_keep_their_case(spark):
    """Sigma before an apostrophe or a dot, dotted I, Kelvin sign and long s: only A to Z change."""
    long = "a b ΟΔΟΣ'Α c ΟΔΟΣ. d İK ſt E f"
    bench = [(1, "ΟΔΟΣ'Α"), (2, long + " g h i j"), (3, "İSTANBUL K"), (4, "οδος"), (5, "MIXED Case")]
    rows = [(1, "ΟΔΟΣ'Α"), (2, "x y ΟΔΟΣ'Α z"), (3, long.replace("E", "e") + " G h i j"), (4, "İstanbul K"), (5, "i̇stanbul k"), (6, "mixed cASE"), (7, "ΟΔΟς Α")]
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, t, 1) for i, t in bench], BENCH))
    want = contaminated(rows, bench)
    assert Counter(map(tuple, got.drop("__k1", "__k2").collect())) == want
    assert {r[0] for r in want if r[5]} == {1, 2, 3, 4, 6}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def components(rows):
    sets = [shingles(t) for _, t in rows]
    head = list(range(len(rows)))

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                head[top(i)] = top(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[top(i)].append(doc)
    return Counter((doc, len(sets[i]), min(ids[top(i)], default=None)) for i, (doc, _) in enumerate(rows))


def test_components(docs, rows, empty):
    got = jaccard.join_components(docs).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == components(rows)
    assert jaccard.join_components(empty).count() == 0


def test_chain_of_links(spark):
    """Copies that drift away from the first, so that far ones link only through those between."""
    w = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(w)))
        w[(7 * i) % 100] = f"v{i}"
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == components(rows)


def test_tree_alone_finds_all(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    monkeypatch.setattr(jaccard, "PART", 12)
    monkeypatch.setattr(jaccard, "LEAF", 3)
    got = jaccard.join_components(docs).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == components(rows)


def test_one_of_each(docs, rows):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c[2] for c in components(rows) if c[2] is not None}
    assert want == {r.doc_id for r in kept.collect() if r.doc_id is not None}
    assert max(Counter((r.doc_id, r.text) for r in kept.collect()).values()) == 1


def templates(lines, depth, similarity):
    """Template of each masked line (a tuple of tokens) by the tree: ``lines`` maps lines to their documents."""
    head = {w: w for w in lines}

    def top(w):
        while head[w] != w:
            w = head[w]
        return w

    branches = defaultdict(set)
    for w in lines:
        n, need = len(w), math.ceil(similarity * len(w))
        rest = max(n - depth, 1)
        parts = min(n - need + 1, rest)
        edges = [depth + -(-s * rest // parts) for s in range(parts + 1)]
        for s in range(parts):
            branches[n, w[:depth], s, w[edges[s] : edges[s + 1]]].add(w)
    shared = {b: ws for b, ws in branches.items() if len(ws) > 1 and len(set().union(*(lines[w] for w in ws))) > 1}
    chosen = defaultdict(set)
    for w in lines:
        own = sorted((-len(ws), b[2], b) for b, ws in shared.items() if w in ws)
        for _, _, b in own[:2]:
            chosen[b].add(w)
    for branch, members in chosen.items():
        places = [Counter(w[i] for w in members) for i in range(branch[0])]
        template = [max(c.items(), key=lambda x: (x[1], x[0].encode()))[0] for c in places]
        same = [w for w in members if sum(a == b for a, b in zip(w, template)) >= math.ceil(similarity * len(w))]
        for w in same:
            head[top(w)] = top(same[0])
    return {w: top(w) for w in lines}


def dropped(rows, min_docs=2, depth=3, min_tokens=5, similarity=0.8):
    found, lines = [], defaultdict(set)
    for at, (doc, text) in enumerate(rows):
        for no, raw in enumerate((text or "").split("\n") if text is not None else ()):
            w = tuple("<*>" if re.search("[0-9]", x) else x for x in raw.translate(str.maketrans("\t\r", "  ")).strip(" ").split(" "))
            if len(w) >= min_tokens and "".join(w):
                found.append((at, (doc, text), no, w))
                lines[w].add((doc, text))
    names = templates(lines, depth, similarity)
    who, first = defaultdict(set), {}
    for _, doc, no, w in found:
        who[names[w]].add(doc)
        place = (doc[0] is None, doc[0] or 0, no)
        first[names[w]] = min(first.get(names[w], place), place)
    gone = defaultdict(set)
    for at, doc, no, w in found:
        if len(who[names[w]]) >= min_docs and (doc[0] is None, doc[0] or 0, no) != first[names[w]]:
            gone[at].add(no)
    return Counter((doc, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[at]) if t is not None else None, len(gone[at])) for at, (doc, t) in enumerate(rows))


def test_template_lines(docs, rows, empty):
    for min_docs in (2, 4):
        got = line_templates.drop_recurring_lines(docs, min_docs)
        assert got.columns == [*docs.columns, "__dropped"]
        assert Counter(map(tuple, got.select("doc_id", "text", "__dropped").collect())) == dropped(rows, min_docs)
    assert line_templates.drop_recurring_lines(empty).count() == 0


def test_variable_fields(spark):
    rows = [(i, f"visitor {i} came from the {w} gate at noon sharp\nown line number of {w} and {w} {w}") for i, w in enumerate(["north", "south", "east", "west"])]
    got = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].text == rows[0][1]
    assert [r.text for r in got[1:]] == [t.split("\n")[1] for _, t in rows[1:]]


def collapsed(spark, texts):
    """The lines left of documents of one line each."""
    got = line_templates.drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert Counter(map(tuple, got.select("doc_id", "text", "__dropped").collect())) == dropped(list(enumerate(texts)))
    return [r.text for r in got.orderBy("doc_id").collect()]


def test_fields_whose_values_recur(spark):
    """Each value of the field stands in several documents; more documents change nothing."""
    for copies in (1, 2, 30):
        texts = [f"visitor list of the {gate} gate at noon" for gate in ("north", "south") for _ in range(copies)] + ["nothing like the others in any of its places"]
        assert collapsed(spark, texts) == [texts[0], *[""] * (2 * copies - 1), texts[-1]]


def test_one_line_edited_at_three_places(spark):
    line = "all of the visitors came through the old gate before noon today".split(" ")
    edits = [" ".join(w if i != at else "changed" for i, w in enumerate(line)) for at in (3, 7, 10)]
    assert collapsed(spark, edits) == [edits[0], "", ""]
    assert collapsed(spark, [*edits, " ".join(line), " ".join(line)]) == [edits[0], "", "", "", ""]


def test_unlike_lines_of_one_leaf_stay(spark):
    rng = random.Random(9)
    texts = ["one of the " + " ".join(rng.choice(["gate", "noon", "list", "old", "new", "hall", "door", "rain", "sun", "wind"]) for _ in range(9)) for _ in range(60)]
    left = collapsed(spark, texts)
    assert sum(bool(x) for x in left) >= 50


def first_of_each(texts, depth=3, similarity=0.8):
    """Documents of one line each, emptied but for the first of its group, every line being in all of its branches."""
    where = defaultdict(set)
    for doc, text in enumerate(texts):
        where[tuple(text.split(" "))].add(doc)
    branches = defaultdict(list)
    for w in where:
        rest = len(w) - depth
        parts = min(len(w) - math.ceil(similarity * len(w)) + 1, rest)
        cuts = [depth + -(-s * rest // parts) for s in range(parts + 1)]
        for s in range(parts):
            branches[len(w), w[:depth], s, w[cuts[s] : cuts[s + 1]]].append(w)
    group = {w: {w} for w in where}
    for ws in branches.values():
        template = [max(c, key=lambda t: (c[t], t.encode())) for c in map(Counter, zip(*ws, strict=True))]
        members = [w for w in ws if sum(a == b for a, b in zip(w, template, strict=True)) >= math.ceil(similarity * len(w))]
        if len(ws) > 1 and len(set().union(*(where[w] for w in ws))) > 1 and members:
            joined = set().union(*(group[w] for w in members))
            group.update({w: joined for w in joined})
    return [t if d == min(set().union(*(where[w] for w in group[tuple(t.split(" "))]))) else "" for d, t in enumerate(texts)]


def test_lines_that_share_none_but_a_small_branch(spark):
    """Both lines have two fuller branches each, whose templates they do not agree with."""
    near = ["north of the gate we met two men and a dog", "north of the gate we saw two men but a dog"]
    full = [f"{'north of the gate we met' if k < 4 else 'north of the gate we saw'} {' '.join(f'z{c}{chr(97 + k)}' for c in 'abcde')}" for k in range(8)]
    full += [f"north of the {' '.join(f'y{c}{chr(97 + k)}' for c in 'abc')} two men {'and' if k < 4 else 'but'} {' '.join(f'y{c}{chr(97 + k)}' for c in 'de')}" for k in range(8)]
    texts = [*near, *full]
    want = first_of_each(texts)
    assert want[:2] == [near[0], ""]
    got = line_templates.drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.text for r in got.orderBy("doc_id").collect()] == want


def test_lines_in_all_of_their_branches(spark):
    """Few tokens at each place, so branches overlap, hold one another or are the same, and templates have ties."""
    for seed in range(3):
        rng = random.Random(seed)
        texts = [" ".join(["all", "of", rng.choice(["the", "a"])] + [rng.choice(["é", "b", "ü", "d"]) for _ in range(rng.choice([2, 8, 9, 17]))]) for _ in range(160)]
        for at in range(0, 160, 3):
            w = rng.choice(texts[:at] or texts).split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(3, len(w))] = rng.choice(["x", "b", "é"])
            texts[at] = " ".join(w)
        got = line_templates.drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert [r.text for r in got.orderBy("doc_id").collect()] == first_of_each(texts)
