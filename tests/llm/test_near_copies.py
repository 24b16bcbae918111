import random

from newstide.llm import copies

from . import corpus


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) >= 0.8 * len(x | y)


def edited(rnd, n):
    """Texts of ``n`` words and copies of them with words replaced, similarity 0.5 to 1."""
    out = []
    for k in range(40):
        base = [f"w{rnd.randrange(5000)}" for _ in range(n)]
        out.append((k * 10, " ".join(base)))
        for copy in range(1, 4):
            other = list(base)
            for _ in range(rnd.randint(1, max(1, n // 30))):
                other[rnd.randrange(n)] = f"x{rnd.randrange(5000)}"
            out.append((k * 10 + copy, " ".join(other)))
    return out


def groups(pairs):
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if similar(pairs[a][1], pairs[b][1]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), str(least.get(find(k)))) for k, (i, _) in enumerate(pairs))


def test_near_copies_are_those_of_all_pairs(spark):
    pairs = edited(random.Random(0), 120) + [(i + 5000 if i is not None else None, t) for i, t, *_ in corpus.rows(3)]
    got = copies.near_copies(corpus.frame(spark, corpus.docs_of(pairs))).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == groups(pairs)


def test_pipeline_stage_drops_near_copies(spark, sf):
    import corpus_pipeline

    pairs = edited(random.Random(1), 150)
    docs = corpus.frame(spark, corpus.docs_of(pairs))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({int(c) for i, c in groups(pairs) if i == c})
    assert not corpus_pipeline.drop_near_duplicates(spark, corpus.frame(spark, []), sf).collect()


def test_no_text_of_a_repeated_id_is_lost(spark):
    rnd = random.Random(2)
    a, b, c = (" ".join(f"{x}{rnd.randrange(900)}" for _ in range(80)) for x in "abc")
    rows = corpus.docs_of([(3, a), (5, a), (5, b), (7, b), (5, b), (None, a), (9, c), (9, a), (2, None), (4, "")])
    docs = spark.createDataFrame(rows, corpus.SCHEMA.replace("g int", "kept_id int").replace("p int", "key int").replace("part int", "row int"))
    kept = copies.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("3", a), ("5", b), ("None", a), ("9", c), ("2", None)], key=str)


def test_many_texts_of_one_band_are_joined_in_tiles(spark, monkeypatch):
    """A chain of copies: each is near the next, the ends are not, and none need be near the smallest."""
    monkeypatch.setattr(copies, "TILE", 8)
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    pairs = []
    for k in range(60):
        base = list(base)
        base[rnd.randrange(200)] = f"n{k}"
        pairs.append((k, " ".join(base)))
    pairs += [(100 + k, f"other {k} " + " ".join(f"o{k}x{m}" for m in range(30))) for k in range(20)]
    rnd.shuffle(pairs)
    got = copies.near_copies(corpus.frame(spark, corpus.docs_of(pairs))).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == groups(pairs)
