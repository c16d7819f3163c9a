"""op13: the prefix trie of all ``conversations``, each rebuilt on the first turns of its group."""

from pyspark.sql import DataFrame, SparkSession

from llm.registry import query
from llm.trie import prefix_trie, rebuilt, turn_sequences

#: The checksum of the id as text is spelled out: a table of 256 entries by its rule, then one step per character.
ORACLE_OP13 = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, key, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) AS pos FROM turns
), convs AS (
  SELECT conv_id, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc
), built AS (
  SELECT c.conv_id, o.pos, o.key, o.words FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, o.pos, o.key, o.words FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h
), numbered AS (
  SELECT conv_id, key, words, row_number() OVER w AS depth, string_agg(key, '') OVER w AS prefix FROM built WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), paths AS (
  SELECT conv_id, depth, md5(prefix) AS node, words FROM numbered UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), ended AS (
  SELECT *, lag(node) OVER w AS parent, lead(depth) OVER w IS NULL AS last FROM paths WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM ended GROUP BY node, depth
), family AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.parent = n.node) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.node = n.parent
), below AS (
  SELECT a.node, sum(f.saved)::BIGINT AS saved_tokens, count(*) FILTER (f.n_children = 0) AS n_leaves
  FROM family f JOIN paths a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.node
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM family JOIN below USING (node)
"""


@query("op13_prefix_trie", ORACLE_OP13)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(rebuilt(turn_sequences(turns)))
