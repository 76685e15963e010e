"""The queries of ``__spark_entry__`` in SQL for DuckDB."""

STATUS = ["F", "O", "P"]
PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
CLASSES = [*STATUS, "unknown"]
WIDTH = 12


def word(text: str, index: int = 0) -> str:
    """One 32-bit word of an md5 digest."""
    return f"('0x' || substr(md5({text}), {1 + 8 * index}, 8))::BIGINT"


def ranked(table: str, key: str, salt: str, by: str = "") -> str:
    """The table with ``r``, the rank (from 1) in hash order."""
    return (
        f"SELECT *, row_number() OVER ({by} ORDER BY h, {key}) AS r"
        f" FROM (SELECT *, {word(f"'{salt}:' || {key}")} AS h FROM {table})"
    )


def columns(prefix: str, width: int, expression="{c}") -> str:
    names = [f"{prefix}{i + 1}" for i in range(width)]
    return ", ".join(f"{expression.format(c=n)} AS {n}" for n in names)


def one_hot(column: str, levels) -> list[str]:
    hot = [f"CASE WHEN {column} = '{v}' THEN 1.0::DOUBLE ELSE 0.0 END" for v in levels]
    listed = ", ".join(f"'{v}'" for v in levels)
    return [*hot, f"CASE WHEN {column} IN ({listed}) THEN 0.0::DOUBLE ELSE 1.0 END"]


def orders_matrix() -> str:
    """CTE ``prep``: key, status and f1..f12."""
    cells = [
        "(o_custkey - (SELECT avg(o_custkey) FROM orders)) / (SELECT stddev_samp(o_custkey) FROM orders)",
        "(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders)",
        *one_hot("o_orderstatus", STATUS),
        *one_hot("o_orderpriority", PRIORITY),
    ]
    named = ", ".join(f"{c} AS f{i + 1}" for i, c in enumerate(cells))
    return f"prep AS (SELECT o_orderkey, o_orderstatus, {named} FROM orders)"


def orders_cells() -> str:
    """CTE ``cells``: one row per key and feature j (from 0)."""
    parts = [f"SELECT o_orderkey AS key, {i} AS j, f{i + 1} AS x FROM prep" for i in range(WIDTH)]
    return f"{orders_matrix()}, cells AS ({' UNION ALL '.join(parts)})"


def batches(source: str, key: str, size: int) -> str:
    """CTE ``batches``: key, batch, pos and the batch's row count."""
    inner = ranked(f"(SELECT {key} AS key FROM {source})", "key", "0:batch:0")
    return f"""batches AS (
      SELECT key, (r - 1) // {size} AS batch, ((r - 1) % {size})::INTEGER AS pos,
             count(*) OVER (PARTITION BY (r - 1) // {size}) AS members
      FROM ({inner}))"""


def corrupted() -> str:
    """CTE ``views``: key, batch, j, x and its corrupted value y, from ``cells`` and ``batches``."""
    text = "'0:cell:0:' || c.key || ':' || c.j"
    return f"""drawn AS (
      SELECT c.key, b.batch, c.j, c.x, {word(text)}::DOUBLE / 4294967296 < 0.6::DOUBLE AS hit,
             {word(text, 1)} % b.members AS donor
      FROM cells c JOIN batches b USING (key)),
    placed AS (SELECT c.j, c.x, b.batch, b.pos FROM cells c JOIN batches b USING (key)),
    views AS (
      SELECT d.key, d.batch, d.j, d.x, CASE WHEN d.hit THEN p.x ELSE d.x END AS y
      FROM drawn d JOIN placed p ON p.batch = d.batch AND p.pos = d.donor AND p.j = d.j)"""


def contrasts() -> str:
    """CTE ``rows``: positive, nearest, average similarity and loss per key and view."""
    return """z AS (
      SELECT key, batch, 0 AS view, list(x ORDER BY j) AS u FROM views GROUP BY key, batch
      UNION ALL
      SELECT key, batch, 1 AS view, list(y ORDER BY j) AS u FROM views GROUP BY key, batch),
    n AS (SELECT *, greatest(sqrt(list_inner_product(u, u)), 1e-12) AS norm FROM z),
    rows AS (
      SELECT a.batch, a.key, a.view,
             max(CASE WHEN a.key = b.key THEN s END) AS positive, max(s) AS nearest, avg(s) AS average,
             ln(sum(exp(s))) - max(CASE WHEN a.key = b.key THEN s END) AS loss
      FROM (SELECT a, b, list_inner_product(a.u, b.u) / (a.norm * b.norm) / 0.5 AS s
            FROM n a JOIN n b ON a.batch = b.batch AND NOT (a.key = b.key AND a.view = b.view))
      GROUP BY a.batch, a.key, a.view)"""


def fixed(text: str) -> str:
    return f"(({word(text)} % 4096)::DOUBLE / 4096 - 0.5)"


def dense(source: str, name: str, layer: int, norm: bool) -> str:
    """CTE with the next layer in long form (key, j, x)."""
    weight = fixed(f"'w:{layer}:' || o.i || ':' || c.j")
    bias = fixed(f"'b:{layer}:' || o.i")
    value = f"sum(c.x * {weight}) + any_value({bias})"
    if norm:
        value = f"greatest(({value} - 0.0625) / sqrt(1.5::DOUBLE + 1e-5::DOUBLE) * 1.25 + 0.125, 0)"
    return f"""{name} AS (
      SELECT c.key, o.i AS j, {value} AS x
      FROM {source} c CROSS JOIN range(4) o(i) GROUP BY c.key, o.i)"""


def latent() -> str:
    """CTE ``latent``: key and h1..h4 of the fixed encoder."""
    pivot = ", ".join(f"max(CASE WHEN j = {i} THEN x END) AS h{i + 1}" for i in range(4))
    layers = [dense("cells", "d1", 1, True), dense("d1", "d2", 2, True), dense("d2", "d3", 3, False)]
    return f"{orders_cells()}, {', '.join(layers)}, latent AS (SELECT key AS o_orderkey, {pivot} FROM d3 GROUP BY key)"


def predictions() -> str:
    """CTE ``predicted``: the class with the largest of h1..h4."""
    names = ", ".join(f"'{c}'" for c in CLASSES)
    return f"""{latent()}, predicted AS (
      SELECT o_orderkey, o_orderstatus,
             list_extract([{names}], list_position([h1, h2, h3, h4], greatest(h1, h2, h3, h4))) AS prediction
      FROM latent JOIN orders USING (o_orderkey))"""


def confusion() -> str:
    """CTE ``matrix`` over all pairs of classes."""
    names = ", ".join(f"('{c}')" for c in CLASSES)
    return f"""{predictions()}, matrix AS (
      SELECT p.c AS predicted, r.c AS real, count(o_orderkey) AS n
      FROM (VALUES {names}) p(c) CROSS JOIN (VALUES {names}) r(c)
      LEFT JOIN predicted ON prediction = p.c AND o_orderstatus = r.c
      GROUP BY p.c, r.c)"""


def neighbour_votes() -> str:
    """CTE ``won``: the class that the 5 nearest neighbours give each of the held-out fifth of the embeddings."""
    split = ranked("embeddings", "vec_id", "0:split")
    return f"""
    WITH split AS (SELECT vec_id, embedding::DOUBLE[] AS e, label,
                          r <= floor(0.2 * count(*) OVER ()) AS held FROM ({split})),
    pairs AS (
      SELECT q.vec_id, q.label AS real, t.label,
             row_number() OVER (PARTITION BY q.vec_id
                                ORDER BY round(list_distance(q.e, t.e) ** 2, 9), t.vec_id::VARCHAR) AS place
      FROM split q JOIN split t ON q.held AND NOT t.held),
    votes AS (SELECT vec_id, real, label, count(*) AS n FROM pairs WHERE place <= 5 GROUP BY ALL),
    won AS (
      SELECT vec_id, real, label AS predicted FROM votes
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1)"""


def neighbours() -> str:
    """Confusion counts of those votes."""
    return f"""{neighbour_votes()},
    levels AS (SELECT DISTINCT label FROM split WHERE NOT held)
    SELECT p.label::VARCHAR AS predicted, r.label::VARCHAR AS real, count(won.real) AS n
    FROM levels p CROSS JOIN levels r LEFT JOIN won ON won.predicted = p.label AND won.real = r.label
    GROUP BY p.label, r.label"""


URGENCY = """CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high'
                 WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END"""
HEAD = f"""
    SELECT {URGENCY} AS label, count(*) AS n, 0::BIGINT AS bad_probability, 0::BIGINT AS no_class,
           true AS learned
    FROM ({ranked('orders', 'o_orderkey', '0:split')}) WHERE r <= floor(0.2 * (SELECT count(*) FROM orders))
    GROUP BY ALL"""


def statements() -> dict[str, str]:
    matrix, lat = orders_matrix(), latent()
    sample = "SELECT * FROM part WHERE p_brand NOT IN ('Brand#12', 'Brand#34', 'Brand#55')"
    moments = " UNION ALL ".join(
        f"SELECT '{c}' AS name, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd,"
        " NULL::VARCHAR AS levels FROM lineitem"
        for c in (
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        )
    )
    lists = " UNION ALL ".join(
        f"SELECT '{c}', NULL, NULL, string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM lineitem)"
        for c in ("l_returnflag", "l_linestatus")
    )
    mask = ", ".join(
        f"({word(f"'0:cell:0:' || o_orderkey || ':{j}'")}::DOUBLE / 4294967296 < 0.6::DOUBLE)::INTEGER AS m{j + 1}"
        for j in range(WIDTH)
    )
    pivot = ", ".join(f"round(max(CASE WHEN j = {j} THEN y END), 6) AS x{j + 1}" for j in range(WIDTH))
    squares = " + ".join(f"f{i + 1} * f{i + 1}" for i in range(WIDTH))
    units = ", ".join(f"round(f{i + 1} / norm, 6) AS u{i + 1}" for i in range(WIDTH))
    segments = ", ".join(
        f"CASE WHEN c_mktsegment = '{v}' THEN 1.0::DOUBLE ELSE 0.0 END AS \"c_mktsegment_{v}\"" for v in SEGMENTS
    )
    exps = " + ".join(f"exp(h{i} - top)" for i in range(1, 5))
    shares = ", ".join(f"round(exp(h{i} - top) / ({exps}), 6) AS p{i}" for i in range(1, 5))
    forward = f"WITH {lat} SELECT o_orderkey, {columns('h', 4, 'round({c}, 6)')} FROM latent"
    terms = ", ".join(
        f"('{t}', 'latent')"
        for t in ["o_custkey", "o_totalprice", *[f"o_orderpriority_{v}" for v in PRIORITY]]
    )
    vectors = "(SELECT vec_id AS key, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings)"
    embedding_views = (
        f"cells AS (SELECT key, j, x::DOUBLE AS x FROM {vectors}),"
        f" {batches('embeddings', 'vec_id', 64)}, {corrupted()}, {contrasts()}"
    )
    order_views = f"{orders_cells()}, {batches('orders', 'o_orderkey', 256)}, {corrupted()}"
    strata = ranked("orders", "o_orderkey", "0:stratum", "PARTITION BY o_orderpriority")
    knn = neighbours()
    return {
        "encoder_forward": forward,
        "model_roundtrip": forward,
        "exclude_columns": "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders",
        "select_numeric": """
            SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax
            FROM lineitem""",
        "validation_split": f"""
            SELECT o_orderkey, CASE WHEN r <= floor(0.1 * count(*) OVER ()) THEN 'validation' ELSE 'train' END AS side
            FROM ({ranked('orders', 'o_orderkey', '0:split')})""",
        "stratified_sample": f"""
            SELECT o_orderkey, o_orderpriority FROM ({strata})
            QUALIFY r <= round_even(0.05 * count(*) OVER (PARTITION BY o_orderpriority), 0)""",
        "drop_zero_variance": "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer",
        "row_key": """
            SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) AS keys
            FROM lineitem GROUP BY l_returnflag, l_linestatus""",
        "prep_matrix": f"WITH {matrix} SELECT o_orderkey, {columns('f', WIDTH, 'round({c}, 6)')} FROM prep",
        "prep_fit_stats": f"{moments} UNION ALL {lists}",
        "prep_bypass": """
            SELECT l_orderkey, l_quantity AS f1, l_extendedprice AS f2, l_linenumber::DOUBLE AS f3 FROM lineitem""",
        "novel_level": f"""
            SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM ({sample})) THEN p_brand
                                   ELSE 'unknown' END AS p_brand
            FROM part""",
        "standardize": """
            SELECT c_custkey,
                   round((c_nationkey - avg(c_nationkey) OVER ()) / stddev_samp(c_nationkey) OVER (), 6) AS c_nationkey,
                   round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS c_acctbal
            FROM customer""",
        "one_hot": f"SELECT c_custkey, {segments} FROM customer",
        "impute_median": """
            SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN value END,
                     (SELECT median(value) FROM events WHERE event_type <> 'error')) AS value
            FROM events""",
        "assign_batches": f"""
            WITH {batches('orders', 'o_orderkey', 256)}
            SELECT key AS o_orderkey, batch, pos FROM batches""",
        "corruption_mask": f"SELECT o_orderkey, {mask} FROM orders",
        "corrupt_features": f"WITH {order_views} SELECT key AS o_orderkey, batch, {pivot} FROM views GROUP BY key, batch",
        "l2_normalize": f"""
            WITH {matrix}
            SELECT o_orderkey, {units} FROM (SELECT *, greatest(sqrt({squares}), 1e-12) AS norm FROM prep)""",
        "batch_similarity": f"""
            WITH {embedding_views}
            SELECT batch, key AS vec_id, view, round(positive, 6) AS positive, round(nearest, 6) AS nearest,
                   round(average, 6) AS average, round(loss, 6) AS loss
            FROM rows""",
        "nt_xent_loss": f"""
            WITH {order_views}, {contrasts()}
            SELECT batch, round(avg(loss), 6) AS loss, count(*) AS views FROM rows GROUP BY batch""",
        "encoder_param_count": """
            SELECT d AS in_dim, 256 * d + 199168 AS parameters, 6::BIGINT AS running_statistics
            FROM (SELECT 2 + count(DISTINCT o_orderpriority) + 1 AS d FROM orders)""",
        "fit_extract": """
            SELECT count(*) AS n, 256 AS width, 0::BIGINT AS not_finite, count(*) AS rows_trained,
                   true AS learned
            FROM orders""",
        "validation_loss": """
            SELECT epoch::INTEGER AS epoch, (n - floor(0.1 * n))::BIGINT AS train_rows,
                   floor(0.1 * n)::BIGINT AS valid_rows, true AS lower_than_before
            FROM (SELECT count(*) AS n FROM orders) CROSS JOIN range(2) e(epoch)""",
        "extract_with_labels": """
            SELECT o_orderstatus AS label, count(*) AS n, 256 AS narrowest, 256 AS widest, 0::BIGINT AS not_finite
            FROM orders GROUP BY o_orderstatus""",
        "split_repeated_keys": """
            SELECT (n - floor(0.1 * n))::BIGINT AS train_rows, floor(0.1 * n)::BIGINT AS valid_rows, orders, sum_of_keys
            FROM (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS orders, sum(o_orderkey)::BIGINT AS sum_of_keys
                  FROM orders)""",
        "sample_equal_rows": """
            SELECT l_returnflag, n FROM (
              SELECT l_returnflag, round_even(0.05::DOUBLE * count(*), 0)::BIGINT AS n FROM lineitem GROUP BY l_returnflag)
            WHERE n > 0""",
        "extract_prepared": "SELECT count(*) AS n, 0::BIGINT AS different FROM orders",
        "boost_history": """
            SELECT i::INTEGER AS round, true AS falls,
                   (SELECT count(DISTINCT CASE WHEN p_size > 34 THEN 2 WHEN p_size > 17 THEN 1 ELSE 0 END) FROM part)::INTEGER AS trees
            FROM range(1, 6) r(i)""",
        "extract_wide": """
            SELECT count(*) AS n, 256 AS dimensions, 'o_orderkey,o_orderstatus,o_orderdate' AS other_columns,
                   0::BIGINT AS not_finite, count(DISTINCT o_orderkey) AS keys
            FROM orders""",
        "classify_mlp": HEAD,
        "classify_custom": HEAD,
        "classify_rf": HEAD,
        "classify_gbt": HEAD,
        "classify_svm": HEAD,
        "classify_tree": HEAD,
        "classify_tree_many": """
            SELECT count(*) AS n, count(DISTINCT (p_brand, p_size > 25)) AS classes,
                   count(DISTINCT (p_brand, p_size > 25)) AS predicted, count(*) AS hits
            FROM part""",
        "classify_small": f"SELECT label, n, bad_probability, no_class FROM ({HEAD})",
        "classify_knn": f"{neighbour_votes()} SELECT vec_id, predicted::VARCHAR AS prediction FROM won",
        "classifier_roundtrip": knn,
        "predict_classes": f"""
            SELECT {URGENCY} AS real, count(*) AS n, 3::BIGINT AS cells, true AS learned FROM orders GROUP BY ALL""",
        "label_encode": f"""
            WITH levels AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i
                            FROM (SELECT DISTINCT p_brand FROM ({sample})))
            SELECT p_partkey, i::INTEGER AS label FROM part LEFT JOIN levels USING (p_brand)""",
        "softmax_rows": f"""
            WITH {lat}
            SELECT o_orderkey, {shares} FROM (SELECT *, greatest(h1, h2, h3, h4) AS top FROM latent)""",
        "argmax_label": f"WITH {predictions()} SELECT o_orderkey, prediction FROM predicted",
        "confusion_matrix": f"WITH {confusion()} SELECT predicted, real, n FROM matrix",
        "accuracy": f"""
            WITH {predictions()}
            SELECT count(*) AS n, count(*) FILTER (prediction = o_orderstatus) AS hits,
                   round(count(*) FILTER (prediction = o_orderstatus) / count(*)::DOUBLE * 100, 2) AS accuracy
            FROM predicted""",
        "classification_report": f"""
            WITH {confusion()}
            SELECT predicted, real, n,
                   round((SELECT sum(n) FILTER (predicted = real) / sum(n)::DOUBLE FROM matrix) * 100, 2) AS accuracy
            FROM matrix""",
        "stage_extract": """
            SELECT o_orderstatus AS label, count(*) AS n, 256 AS dimensions,
                   'o_orderkey,o_orderstatus' AS other_columns, 0::BIGINT AS not_finite
            FROM orders GROUP BY o_orderstatus""",
        "tidy_stage": f"""
            SELECT terms, id FROM (VALUES {terms}) t(terms, id)
            WHERE replace(terms, 'o_orderpriority_', '') IN (SELECT o_orderpriority FROM orders)
               OR terms IN ('o_custkey', 'o_totalprice')""",
    }
