"""The views of `sources.views` in SQL, in dependency order."""

VIEW_SQL: dict[str, str] = {
    "runs": """
        SELECT CAST(user_id % 3 AS INTEGER) AS iteration, user_id AS structure, event_id AS config,
               CASE WHEN event_type IN ('purchase','click','view') THEN 'SUCCESS'
                    WHEN event_type = 'signup' THEN 'TIMEOUT' ELSE 'CRASHED' END AS status,
               CASE WHEN event_type IN ('purchase','click','view') THEN -value/500 ELSE 0e0 END AS loss,
               CASE WHEN event_type IN ('purchase','click','view') THEN -value/500 ELSE 0e0 END AS structure_loss,
               event_type AS origin, ts, value AS training_time
        FROM events""",
    "structures": """
        SELECT DISTINCT iteration, structure, CAST(structure % 5 + 1 AS INTEGER) AS budget,
               CAST(structure % 4 AS INTEGER) AS rung
        FROM runs""",
    "chain_steps": """
        SELECT concat_ws('/', CAST(user_id AS VARCHAR), day) AS chain,
               user_id AS structure, CAST(rn AS INTEGER) AS pos, event_type AS step, -value/500 AS loss
        FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day,
                     row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) - 1 AS rn
              FROM events)""",
    "chains": """
        SELECT chain, structure, list(step ORDER BY pos) AS steps, list(loss * -500 ORDER BY pos) AS times, arg_max(loss, pos) AS reward
        FROM chain_steps GROUP BY chain, structure""",
    "bench": """
        SELECT n_name AS task, o_orderpriority AS system, CAST(o_orderkey % 10 AS INTEGER) AS fold,
               CASE WHEN n_nationkey % 2 = 0 THEN 'auc' ELSE 'logloss' END AS metric,
               CASE WHEN (n_nationkey + o_orderkey % 10) % 7 = 0 THEN NULL
                    ELSE avg(o_totalprice)/500000 END AS result
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY n_name, n_nationkey, o_orderpriority, o_orderkey % 10""",
    "traj": """
        SELECT event_type AS system, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 1000000 AS sec,
               min(least(value/500, 1e0)) AS score
        FROM events GROUP BY ALL""",
    "ticks": """
        SELECT unnest(generate_series(0, (SELECT max(sec) FROM traj), 3600)) AS sec""",
    "lines": """
        SELECT l_orderkey*10 + l_linenumber AS row_id, max(l_linestatus) AS status, max(l_returnflag) AS flag,
               min(l_discount) AS discount, min(l_tax) AS tax, min(l_quantity) AS quantity
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "preds_bin": """
        SELECT row_id, CAST(status = 'O' AS INTEGER) AS y,
               greatest(0.001e0, least(0.999e0, discount*10)) AS p,
               CAST(greatest(0.001e0, least(0.999e0, discount*10)) >= 0.5e0 AS INTEGER) AS pred
        FROM lines""",
    "preds_multi": """
        SELECT row_id, flag AS y, a/(a+n+r) AS pa, n/(a+n+r) AS pn, r/(a+n+r) AS pr,
               CASE WHEN a = greatest(a,n,r) THEN 'A' WHEN n = greatest(a,n,r) THEN 'N' ELSE 'R' END AS pred
        FROM (SELECT row_id, flag, discount*10+0.1e0 AS a, tax*12+0.1e0 AS n, quantity/50+0.1e0 AS r FROM lines)""",
    "preds": """
        SELECT m AS model_id, row_id, y, 0.5e0*p + 0.5e0*(((row_id*(2*m+1)) % 97 + 1)/99e0) AS p
        FROM preds_bin, (SELECT CAST(unnest(generate_series(1, 10)) AS INTEGER) AS m)""",
    "vectors": """
        SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS mf, label FROM embeddings""",
    "config_rows": """
        SELECT l_suppkey AS space_id, l_quantity/50 AS quantity, l_discount*10 AS discount, l_tax*12 AS tax,
               CASE l_returnflag WHEN 'A' THEN 0e0 WHEN 'N' THEN 1e0 ELSE 2e0 END AS flag,
               -l_extendedprice/100000 AS loss
        FROM lineitem""",
    "step_configs": """
        SELECT l_orderkey AS run_id, l_linenumber AS step_no, min(l_quantity) AS quantity, min(l_tax) AS tax,
               min(CASE l_returnflag WHEN 'A' THEN 'Default' WHEN 'N' THEN 'Hyperopt' ELSE 'Random Search' END) AS origin,
               sum(l_extendedprice) AS price
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "quality_docs": """
        SELECT d.doc_id, lang, source, n_chars, quality AS label FROM documents d JOIN labels USING (doc_id)""",
}
