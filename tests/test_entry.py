import importlib
import importlib.util
import math
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
CHECKED = ["us_entropy_top20", "pwc_knn_freq", "qbc_vote_entropy", "mcpal_m2", "core_set_k3", "gsi", "prob_cover_k3", "contrastive_knn", "nic_mean_std", "emvr_linear", "confusion_all", "majority_vote", "ie_threshold", "sa_wrapper_pairs", "variable_uncertainty_stream", "decision_boundary", "interval_estimation_upper", "annotator_query", "combine_ranking", "combine_ranking_per", "biqf_stream", "probabilistic_stream", "emvr_gauss_hermite", "kl_max", "emoc_absolute", "expected_target", "bayesian_linear", "qbc_kl", "bald", "qbc_std", "parallel_utilities"]


def entry():
    sys.path.insert(0, str(ROOT))
    return importlib.import_module("__spark_entry__")


def rows(cols, data):
    return sorted(tuple(None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0 if isinstance(v, int | float) else str(v) for v in r) for r in data)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    e = entry()
    got = e.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("embeddings", "part", "events", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(e.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    data = want[cols].astype(object).where(want[cols].notna(), None)
    assert rows(cols, [tuple(r) for r in got.select(*cols).collect()]) == rows(cols, data.itertuples(index=False))


def test_flagship_and_names(spark):
    e = entry()
    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_does_without_the_text_operators():
    for f in [*(ROOT / "lodestar").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        if "llm" not in f.relative_to(ROOT).parts and f.name != "test_entry.py":
            assert not re.search(r"lodestar[. ]+(import +)?llm|corpus_pipeline", f.read_text()), f
    code = "import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith(('lodestar.llm', 'corpus_pipeline')) else f(n, *a); import __spark_entry__ as e; q = e.queries(); assert 'us_entropy' in q and not any(n.startswith('op') or n == 'pipeline' for n in q), list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
