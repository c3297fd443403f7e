"""The registered queries: columns, types, whole results and (where there is one) the SQL oracle."""

import pathlib

import duckdb
import pytest

import corpus_pipeline
from sparkfolio.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_vp_tree": "query_id bigint, rank int, vec_id bigint, score double",
    "op2_substring_recompression": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op3_decontamination": "doc_id bigint, item_id bigint, cosine double, common double, answer double",
    "op4_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op5_line_dedup": "doc_id bigint, n_lines bigint, kept_chars bigint, kept_sha256 string",
    "op6_secret_markov": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op7_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_simhash_pigeonring": "doc_id bigint, fingerprint string, component_id bigint",
    "op9_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op10_suffix_bpr": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
}
PER_DOCUMENT = [n for n in COLUMNS if n not in ("op1_vp_tree", "op3_decontamination")]


@pytest.fixture(scope="module", autouse=True)
def tables():
    if not pathlib.Path(DATA).exists():
        pytest.skip("no test tables")


def test_all_are_registered():
    assert set(QUERIES) == set(COLUMNS) and [n for n, _ in corpus_pipeline.STAGES] and callable(corpus_pipeline.run)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_schema_and_rows(spark, name):
    df = QUERIES[name](spark, DATA)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name]
    rows = df.count()
    assert rows == spark.read.parquet(f"{DATA}/documents.parquet").count() if name in PER_DOCUMENT else rows > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = sorted(tuple(r[c] for c in sorted(r.asDict())) for r in QUERIES[name](spark, DATA).collect())
    want = con.execute(ORACLE_SQL[name]).df()
    assert got == sorted(want[sorted(want.columns)].itertuples(index=False, name=None))
