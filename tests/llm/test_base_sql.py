"""The columns of secrets and rules that SQL can say, against DuckDB over whole tables."""

import duckdb
import pytest

from sievemill.llm import queries

SF = "/root/testdata/sf0.01"
SECRETS = r"""
SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign,
  len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access, len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
"""
RULES = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
r AS (SELECT doc_id, i FROM g JOIN (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1) USING (doc_id, g)),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(8) s(k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM t) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(w) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(w) AS base_failed FROM w LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
"""


@pytest.mark.parametrize("name,sql", [("op6_secrets", SECRETS), ("op8_rules", RULES)])
def test_base_columns(spark, name, sql):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    out = c.execute(sql)
    columns = [d[0] for d in out.description]
    want = sorted(map(str, out.fetchall()))
    assert sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, SF).select(*columns).collect()) == want
