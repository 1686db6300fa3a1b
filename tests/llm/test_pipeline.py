import collections
import itertools
import math
import random
import re
import zlib

import numpy as np

import corpus_pipeline


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, d), "stage")
        assert docs.columns == columns and 0 < docs.count() <= 3 * n
    out = corpus_pipeline.run(spark, d)
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").isEmpty()
    assert out.where("piece = 0").count() == docs.count()


WORD = re.compile("[^\x20\x09-\x0d]+")


def _write(spark, d):
    """Good and bad texts, near and exact copies, a recurring passage, texts of one doc_id, nulls; labels of the first 120."""
    r = random.Random(3)
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "ra") for b in ("den", "fir", "gol", "hus", "jam", "kep", "tor", "vel")]
    good = lambda n: " ".join(r.choice(words) for _ in range(n))
    bad = lambda n: " ".join(f"XQ{r.randrange(90)}!!" for _ in range(n))
    out = [(i, good(r.randint(30, 90)) if i % 3 else bad(r.randint(30, 90))) for i in range(120)]
    passage, base = good(30), good(150)
    out += [(i, f"{good(20)} {passage} {good(15)}") for i in range(200, 208)]
    out += [(i, f"{base} end{i}") for i in range(210, 216)] + [(i, base) for i in range(216, 220)]
    out += [(300, good(70)), (300, good(50)), (301, good(1500)), (302, None), (303, "")]
    rows = [(i, t, "en", (None, "a", "b", "c")[i % 4], len(t or "")) for i, t in out]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{d}/documents.parquet")
    labelled = [(i, int(i % 3 > 0), 0) for i in range(120)]
    spark.createDataFrame(labelled, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return [(i, t, s) for i, t, _, s, _ in rows], {i: q for i, q, _ in labelled}


def _features(text):
    found = re.findall("[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0d]+", text)
    shapes, before = [], None
    for w in found:
        if not re.match("[0-9A-Za-z\x80-\U0010ffff]", w):
            shapes.append(w)
            continue
        digit, big, small = (len(re.findall(c, w)) for c in ("[0-9]", "[A-Z]", "[a-z]"))
        shape = 3 if w == before else 1 if big > 1 and not small else 2 if digit and not big + small else 4 if len(w) == 1 else 5
        shapes.append(shape)
        before = w
    grams = [(kind, *seq[i : i + k]) for kind, seq, sizes in (("w", found, (1, 2)), ("s", shapes, (1, 2, 3))) for k in sizes for i in range(len(seq) - k + 1)]
    return {g: n * 10.0 / len(found) for g, n in collections.Counter(grams).items()}


def _good(docs, quality):
    """Follow-the-regularised-leader over dictionaries, with features that aren't hashed."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        l1 = 0.0 if k == "bias" else 0.02
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((1 + math.sqrt(n[k])) / 0.3 + 0.01)

    logistic = lambda f: 1 / (1 + math.exp(-f))
    fit = sorted((i, t) for i, t, _ in docs if i in quality and zlib.crc32(str(i).encode()) % 4 != 2)
    rng = np.random.default_rng(0)
    for _ in range(4):
        for k in rng.permutation(len(fit)):
            x = _features(fit[k][1]) | {"bias": 1.0}
            w = {f: weight(f) for f in x}
            off = logistic(sum(w[f] * v for f, v in x.items())) - quality[fit[k][0]]
            for f, v in x.items():
                g = off * v
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / 0.3 * w[f]
                n[f] += g * g
    out = []
    for row in docs:
        x = _features(row[1] or "")
        score = logistic(sum(weight(f) * v for f, v in x.items()) + weight("bias")) if x else 0.0
        assert abs(score - 0.7) > 1e-3
        out += [row] if score >= 0.7 else []
    return out


def _apart(docs):
    bags = []
    for _, t, _ in docs:
        w = WORD.findall(t or "")
        bags.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    root = list(range(len(docs)))
    for a, b in itertools.combinations(range(len(docs)), 2):
        if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    return [d for k, d in enumerate(docs) if root[k] == k]


def _without_passages(docs):
    first, out = {}, []
    split = [(i, WORD.findall(t or ""), t, s) for i, t, s in docs]
    for i, w, _, _ in split:
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), i), i)
    for i, w, t, s in split:
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out.append((i, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t, s))
    return out


def _mixed(docs):
    """The draws, the queue, the targets and the budget, one document after another."""
    sized = [(i, s, len(WORD.findall(t or ""))) for i, t, s in docs]
    key = {}
    for k, (i, _, n) in enumerate(sized):
        x = (((-1 if i is None else i) * 31 + n % 1000) * 48271 + 11 * 7919 + 1) % (2**31 - 1)
        key[k] = ((x * x + x + 11) % (2**31 - 1) * 69621 + 1) % (2**31 - 1)
    size = collections.Counter()
    for _, s, n in sized:
        size[s] += n
    weight = {s: (1, 2, 3)[j % 3] for j, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    left, free, goal = float(sum(size.values())), set(size), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        goal |= {s: 3.0 * size[s] for s in over} or share
        left -= sum(3 * size[s] for s in over)
        free = free - over if over else set()
    upto, line = collections.Counter(), []
    for k in sorted(key, key=lambda k: (key[k], sized[k][0], sized[k][2])):
        i, s, n = sized[k]
        upto[s] += n
        line += [((e * size[s] + upto[s]) / goal[s], key[k], i, n) for e in range(3) if n]
    budget, times = sum(size.values()), collections.Counter()
    for _, h, i, n in sorted(line):
        if n > budget:
            break
        budget -= n
        times[i, h] += 1
    most = collections.Counter()
    for (i, _), n in times.items():
        most[i] = max(most[i], n)
    return [d for d in docs for _ in range(most[d[0]])]


def test_against_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, quality = _write(spark, tmp_path)
    steps = [docs := _good(docs, quality), docs := _apart(sorted(docs, key=lambda d: d[0])), docs := _without_passages(docs), docs := _mixed(docs)]
    assert len(steps[0]) > len(steps[1]) and steps[1] != steps[2] and sorted(map(repr, steps[2])) != sorted(map(repr, steps[3]))
    assert sum(i == 300 for i, _, _ in steps[1]) == 2
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES, steps, strict=False):
        got = corpus_pipeline.cut(stage(spark, got, str(tmp_path)), "stage")
        assert collections.Counter((r.doc_id, r.text, r.source) for r in got.collect()) == collections.Counter(want), name
    exact, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), collections.Counter()
    for i, t, _ in docs:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        edges = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for k, (a, z) in enumerate(itertools.pairwise(edges)):
            want[i, k, a, z - a, zlib.crc32(ids[a:z].tobytes())] += 1
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for line in places.values():
        line.sort()
        assert [o for o, _ in line] == [0, *itertools.accumulate(n for _, n in line)][:-1] and sum(n for _, n in line) <= 1024


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_columns(spark, tmp_path):
    """Null ids, ties, repeated rows, null and empty texts, columns of the operators' own names: every stage gives whole
    rows of its input's columns, and what it is to keep stays."""
    r = random.Random(9)
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi") for b in ("den", "fir", "gol", "hus", "jam", "kep")]
    good = lambda n: " ".join(r.choice(words) for _ in range(n))
    odd = ["__id", "__times", "__quality", "__shard", "n_words", "kept_sha256", "size", "key", "shard"]
    base = [(i, good(40) if i % 4 else " ".join(f"XQ{r.randrange(90)}!!" for _ in range(40))) for i in range(80)]
    rows = base + [(None, good(30)), (None, None), (None, ""), (81, None), (82, ""), (82, " \\n "), base[1], base[1], (83, base[1][1])]
    full = [(i, t, "en", "s" if k % 3 else None, len(t or ""), *[f"{c}{k}" for c in odd]) for k, (i, t) in enumerate(rows)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in odd)
    spark.createDataFrame(full, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 4 > 0), 0) for i in range(80)] + [(None, 1, 0), (5, 1, 0), (6, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    given = {tuple(x) for x in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)), "stage")
        got = [tuple(x) for x in docs.collect()]
        assert docs.columns == [c.split()[0] for c in schema.split(", ")] and set(got) <= given, name
        texts = {x[1] for x in got}
        if name != "mixing":  # which takes some sources in part
            assert base[1][1] in texts and base[7][1] in texts, name
        if name in ("near-dedup", "substring dedup"):  # one of the equal texts
            assert len({x[0] for x in got if x[1] == base[1][1]}) == 1, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == len(got) and all(x.length <= 1024 for x in out)
