"""The pipeline against plain versions of its stages, composed."""

import hashlib
import itertools
import random
import re

import corpus_pipeline
from celltrail.llm import bpe, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_lines(docs):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    gone = {k: max(ids) for k, ids in held.items() if len(k) >= 20 and len(ids) >= 3}
    return {i: "\n".join(x for x in (t or "").split("\n") if gone.get(key(x), i) == i) for i, t in docs.items()}


def plain_distinct(docs):
    sets = {}
    for i, t in docs.items():
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return {i: t for i, t in docs.items() if root[i] == i}


def plain_clean(docs, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9))} if w else set()
    out = {}
    for i, t in docs.items():
        w = words(t)
        if not any(tuple(w[j : j + n]) in windows for n in {len(x) for x in windows} for j in range(len(w) - n + 1)):
            out[i] = t
    return out


def tables(spark, folder, n=160):
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefghi", k=rng.randint(2, 7))) for _ in range(400)]
    items = [" ".join(rng.choices(vocab, k=25)), "", None, "short item zzz"]
    docs = [(0, None, None, None, None), (1, "", "en", "s", 0)]
    for i in range(2, n):
        good = i % 3 > 0
        words = rng.choices(vocab, k=rng.randint(30, 200)) if good else ["#$%|" + x.upper() for x in rng.choices(vocab[:5], k=rng.randint(5, 40))]
        lines = [" ".join(words[j : j + 12]) + ("." if good else "!!!") for j in range(0, len(words), 12)]
        if i % 5 == 0:
            lines.insert(1, " Accept all the cookies of this site ")
        if i % 17 == 0:
            lines.append(items[0].upper())
        if i % 29 == 0:
            lines.append("a short, ITEM: zzz")
        docs.append((i, "\n".join(lines), "en", f"s{i % 3}" if i % 7 else None, 1))
        if good and i % 4 == 0:
            docs.append((n + i, docs[-1][1].replace(" ", " x ", 1), "en", "copy", 1))
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    marks = [(d[0], None if d[0] % 11 == 0 else int(d[0] % 3 > 0), 0) for d in docs if d[0] < n]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {d[0]: d[1] for d in docs}, items


def test_pipeline(spark, tmp_path):
    docs, items = tables(spark, str(tmp_path))
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    scores = {r.doc_id: r.score for r in quality.score(read("documents"), quality.train(read("documents"), read("labels"))).collect()}
    kept = {i: t for i, t in docs.items() if scores[i] >= 0.3}
    assert sum(i % 3 > 0 for i in kept if 1 < i < 160) > 100 > 20 > sum(i % 3 == 0 for i in kept if 1 < i < 160)
    lined = plain_lines(kept)
    alone = plain_distinct(lined)
    clean = plain_clean(alone, items)
    assert len(kept) > len(alone) > len(clean) > 60 and lined != kept
    tok = bpe.ChunkEncoder(bpe.tokenizer_path()).tok
    want = {}
    for i, t in clean.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        data = b"".join(x.to_bytes(4, "little") for x in ids)
        want[i] = (len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_stages_keep_their_columns_and_bear_empty_and_repeated_rows(spark, tmp_path):
    tables(spark, str(tmp_path), 40)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == corpus_pipeline.COLUMNS, name
        assert stage(spark, docs.where("doc_id < 0"), str(tmp_path)).count() == 0, name
        assert stage(spark, docs.union(docs), str(tmp_path)).select("doc_id").distinct().count() > 0, name


def test_stages_decide_by_row(spark, tmp_path):
    docs, items = tables(spark, str(tmp_path), 40)
    fine = [docs[i] for i in (2, 4, 7)]
    rows = [(None, fine[0]), (None, fine[1]), (None, items[0]), (1000, fine[2]), (1000, items[0]), (1000, fine[2])]
    for i in range(3):
        rows.append((2000 + i, f"start {i}\na line that is in many documents"))
    rows.append((2000, "another text\na line that is in many documents"))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    run = lambda stage, d=df: sorted(((r.doc_id, r.text) for r in stage(spark, d, str(tmp_path)).collect()), key=str)
    assert {t for i, t in run(corpus_pipeline.good) if i is None} >= {fine[0], fine[1]}
    want = [(i, t.split("\n")[0] if i in (2000, 2001) else t) for i, t in rows]
    assert run(corpus_pipeline.lines) == sorted(want, key=str)
    assert run(corpus_pipeline.clean) == sorted([x for x in rows if x[1] != items[0]], key=str)
    assert [x for x in run(corpus_pipeline.distinct) if x[0] is None] == sorted([x for x in rows if x[0] is None], key=str)
