"""The pipeline against plain versions of its stages, on a small table."""

import random
import re

import public_tokenizers

import corpus_pipeline as P
from corpusgraph.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path):
    r = random.Random(11)
    word = lambda: "".join(r.choice(["th", "er", "on", "ing", "é", "st"]) for _ in range(r.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(40)
    docs = [text(r.randrange(30, 300)) for _ in range(200)]
    docs += docs[:5] + [docs[7] + " tail"]
    docs += [text(20) + " " + item + " " + text(20), item.upper()]
    toxic = [i for i in range(0, 200, 4)]
    for i in toxic:
        docs[i] += " moron idiot moron"
    docs += ['secret = "abcdef123456" ' + text(30), None, ""]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return dict(enumerate(docs)), set(toxic)


def test_pipeline_against_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    from .test_simhash import brute_fp, brute_groups

    docs, toxic = tables(spark, tmp_path)
    pieces = P.run(spark, str(tmp_path)).collect()
    left = {i for i in docs if i not in toxic and "moron" not in (docs[i] or "")}
    ids = sorted(left)
    groups = brute_groups([brute_fp(docs[i]) for i in ids])
    left = {i for k, i in enumerate(ids) if groups[k] == k}
    left -= {i for i in left if (docs[i] or "").upper().startswith(docs[207][:40]) or i == 206}
    assert {p.doc_id for p in pieces} == left
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i in left:
        t = re.sub(r'secret = "abcdef123456', "[SECRET]", docs[i] or "")
        assert sum(p.length for p in pieces if p.doc_id == i) == len(tok.encode(t, add_special_tokens=False).ids) + 1


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert [n for n, _ in P.STAGES] == ["toxicity", "near copies", "decontamination", "secrets", "packing"]


def test_registered_queries_return_their_columns(spark, tmp_path):
    docs, _ = tables(spark, tmp_path)
    want = {
        "op2_simhash": {"doc_id", "fingerprint", "component_id"}, "op3_shards": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op4_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op5_repeats": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
        "op6_language": {"doc_id", "held_out", "lang_pred", "score"}, "op7_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
        "op8_quality": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    }
    for name, columns in want.items():
        got = queries.queries()[name](spark, str(tmp_path))
        assert columns <= set(got.columns)
        assert sorted(r.doc_id for r in got.collect()) == sorted(docs)


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    """Rows are dropped for their own text: null and repeated ids neither save nor cost a row."""
    tables(spark, tmp_path)
    item = spark.read.parquet(f"{tmp_path}/benchmark.parquet").first().text
    plain = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    rows = [(None, plain[0]), (None, plain[0]), (5, plain[0]), (6, plain[1]), (6, plain[1]), (7, plain[2]), (7, plain[3]), (None, plain[3] + " end")]
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    kept = P.drop_near_copies(spark, frame(rows), str(tmp_path)).collect()
    assert sorted((x.doc_id, x.text) for x in kept) == sorted([(5, plain[0]), (6, plain[1]), (7, plain[2]), (7, plain[3])])
    rows = [(None, item), (None, plain[0]), (7, plain[1]), (7, "a " + item + " b")]
    kept = P.drop_contaminated(spark, frame(rows), str(tmp_path)).collect()
    assert sorted((x.doc_id or 0, x.text) for x in kept) == [(0, plain[0]), (7, plain[1])]
