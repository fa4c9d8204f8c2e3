"""DuckDB SQL that gives the rows of queries in queries.py, where SQL can express them."""

def _codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds one after the other, each over all parts: nearest entries, then means; no deltas."""
    ctes = [
        "kept AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"comps AS (SELECT rid, vec_id, label, k // w AS part, k % w AS pos, floor(4096 * embedding[k + 1]::DOUBLE)::BIGINT AS x FROM (SELECT *, len(embedding) // {parts} AS w, unnest(range(len(embedding))) AS k FROM kept))",
        f"book0 AS (SELECT part, rid - 1 AS entry, pos, x AS c FROM comps WHERE rid <= {entries})",
    ]
    for r in range(rounds + 1):
        ctes.append(f"away{r} AS (SELECT rid, part, entry, sum((x - c) * (x - c))::BIGINT AS away FROM comps JOIN book{r} USING (part, pos) GROUP BY rid, part, entry)")
        ctes.append(f"near{r} AS (SELECT rid, part, entry, away FROM away{r} QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY away, entry) = 1)")
        if r < rounds:
            ctes.append(f"mean{r} AS (SELECT part, entry, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM comps JOIN near{r} USING (rid, part) GROUP BY part, entry, pos)")
            ctes.append(f"book{r + 1} AS (SELECT part, entry, pos, coalesce(m, c) AS c FROM book{r} LEFT JOIN mean{r} USING (part, entry, pos))")
    return f"""
        WITH {", ".join(f"{c.split(' AS ', 1)[0]} AS MATERIALIZED {c.split(' AS ', 1)[1]}" for c in ctes)}, coded AS (
            SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(away)::BIGINT AS error FROM near{rounds} GROUP BY rid
        ), books AS (
            SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS digest FROM book{rounds}
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM coded JOIN kept USING (rid), books
    """



ORACLE: dict[str, str] = {
    # every pair of documents that share a shingle, then the smallest id reachable
    "op1_minhash_odd_sketch": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
        ), pairs AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)
        ), links AS (
            SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
        ), reached AS (
            SELECT doc_id AS node, doc_id AS seen FROM documents
            UNION
            SELECT l.b, r.seen FROM reached r JOIN links l ON l.a = r.node
        ), least AS (
            SELECT node, min(seen) AS component_id FROM reached GROUP BY node
        )
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN least ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
    """,
    # both trees as one table of nodes (tree: the language's rank, or -1 above them), then each leaf's siblings step by step
    "op11_merkle_manifest": r"""
        WITH RECURSIVE d AS (
            SELECT *, row_number() OVER () AS rid, CAST(doc_id AS VARCHAR) AS i, CAST(n_chars AS VARCHAR) AS n FROM documents
        ), e AS (
            SELECT rid, doc_id, lang,
                coalesce(strlen(i) || ':' || i, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n) || ':' || n, '-') AS head,
                text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(i, ''), lambda c: ascii(c)::BIGINT)),
                    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) AS crc
            FROM d
        ), leaf AS (
            SELECT rid, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                sha256(head || coalesce(CASE WHEN crc % 3 = 0 THEN strlen(low) || ':' || low ELSE strlen(text) || ':' || text END, '-')) AS given
            FROM e
        ), placed AS (
            SELECT rid, doc_id, leaf, given, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS size FROM leaf
        ), low AS (
            SELECT tree, 0 AS level, idx, size, leaf AS digest FROM placed
            UNION ALL
            SELECT tree, level + 1, idx // 8, (size + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE size > 1 GROUP BY tree, level, idx // 8, size
        ), high AS (
            SELECT -1::BIGINT AS tree, 0 AS level, tree AS idx, count(*) OVER () AS size, digest FROM low WHERE size = 1
            UNION ALL
            SELECT tree, level + 1, idx // 8, (size + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE size > 1 GROUP BY tree, level, idx // 8, size
        ), nodes AS (
            SELECT * FROM low UNION ALL SELECT * FROM high
        ), heights AS (
            SELECT tree, max(level) AS height FROM low GROUP BY tree
        ), steps AS (
            SELECT rid, level AS step, p.tree, level, idx // (8 ** level)::BIGINT AS at FROM placed p JOIN heights h ON h.tree = p.tree, range(20) AS r(level) WHERE level < height
            UNION ALL
            SELECT rid, height + level, -1, level, p.tree // (8 ** level)::BIGINT FROM placed p JOIN heights h ON h.tree = p.tree, range(20) AS r(level) WHERE level < (SELECT max(level) FROM high)
        ), sides AS (
            SELECT s.rid, s.step, coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx < s.at), '') AS before, coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx > s.at), '') AS after
            FROM steps s JOIN nodes n ON n.tree = s.tree AND n.level = s.level AND n.idx // 8 = s.at // 8 GROUP BY s.rid, s.step
        ), proofs AS (
            SELECT rid, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM sides GROUP BY rid
        ), fold AS (
            SELECT rid, 0::BIGINT AS step, given AS digest FROM placed
            UNION ALL
            SELECT f.rid, f.step + 1, sha256(before || digest || after) FROM fold f JOIN sides s ON s.rid = f.rid AND s.step = f.step
        ), folded AS (
            SELECT rid, arg_max(digest, step) AS digest FROM fold GROUP BY rid
        ), root AS (
            SELECT digest FROM high WHERE size = 1
        )
        SELECT doc_id, leaf, b.digest AS subroot, r.digest AS root, coalesce(proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
        FROM placed p JOIN low b ON b.tree = p.tree AND b.size = 1 JOIN folded f ON f.rid = p.rid LEFT JOIN proofs ON proofs.rid = p.rid, root r
    """,
    "op12_vector_codes_delta": _codes(),
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
