import itertools
import math

import pytest

from strandline.functions import sql
from strandline.operators import evaluate


@pytest.mark.parametrize("n", [1, 5, 10, 12])
def test_exact_signed_ranks_by_enumeration(n):
    sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
    w = list(range(n * (n + 1) // 4 + 1))
    import pandas as pd

    got = evaluate._signed_rank_p(pd.Series(w, dtype=float), pd.Series([n] * len(w)))
    assert got.tolist() == pytest.approx([min(1.0, 2 * sum(s <= x for s in sums) / len(sums)) for x in w])


def test_signed_ranks_without_a_global_window(spark):
    d = [0.5, -1.5, 2.5, 3.25, -4.0, 5.0, 6.5, 7.0]
    got = evaluate.wilcoxon(spark.createDataFrame([(x,) for x in d], "d double")).first()
    ranks = {x: i for i, x in enumerate(sorted(d, key=abs), 1)}
    assert (got.w_plus, got.w_minus) == (sum(r for x, r in ranks.items() if x > 0), sum(r for x, r in ranks.items() if x < 0))


def test_functions_in_sql(spark):
    sql.register(spark)
    r = spark.sql("SELECT normal_p(1.96D) AS a, signed_rank_p(3D, 8L) AS b, signed_rank_p(3D, 60L) AS c, binomial_two_sided(1L, 4L) AS d, fisher_greater(3L, 1L, 1L, 3L) AS e").first()
    assert r.a == pytest.approx(math.erfc(1.96 / math.sqrt(2))) and r.b == pytest.approx(2 * 5 / 256) and r.c is None
    assert r.d == pytest.approx(10 / 16) and r.e == pytest.approx(17 / 70)
    spark.createDataFrame([(1, 100), (2, 30), (3, None), (4, 31)], "id int, n long").createOrReplaceTempView("lengths")
    rows = spark.sql("SELECT id, win_idx, start FROM lengths, LATERAL series_windows(n, 30, 20) ORDER BY id, win_idx").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0), (1, 1, 20), (1, 2, 40), (1, 3, 60), (4, 0, 0)]
    assert spark.sql("SELECT id, count(*) AS n FROM lengths, LATERAL series_tiles(n, 10) GROUP BY id ORDER BY id").collect()[0].n == 10
