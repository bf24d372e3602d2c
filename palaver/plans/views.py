"""Chat tables derived from the given test tables.

Each view is a list of column expressions over one table, in the SQL that Spark and the oracle
share; ``spark_view`` makes a DataFrame of it and ``cte`` the same rows for an oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MESSAGE_ID = "conv_id * 1000 + turn"
_AUTHOR = "CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 + conv_id % 7 ELSE 9 END"
_PAYLOAD = (
    "concat('{\"id\":\"', CAST(conv_id * 1000 + turn AS STRING), '\",\"author\":{\"id\":\"', CAST(" + _AUTHOR + " AS STRING), "
    "'\",\"bot\":', CASE WHEN role = 'system' THEN 'true' ELSE 'false' END, '},\"edited_timestamp\":', "
    "CASE WHEN turn % 4 = 3 THEN '\"2024-03-01T02:00:00+02:00\"' ELSE 'null' END, ',\"attachments\":[', "
    "CASE WHEN turn % 2 = 0 THEN concat('{\"url\":\"no id\"},{\"id\":\"', CAST((conv_id * 1000 + turn) * 10 + 1 AS STRING), "
    "'\",\"url\":\"https://cdn.example.com/', CAST(turn AS STRING), '\",\"content_type\":\"image/png\",\"size\":', CAST(100 + turn AS STRING), "
    "',\"filename\":\"f', CAST(turn AS STRING), '.png\"}') ELSE '' END, '],\"embeds\":[', "
    "CASE WHEN turn % 3 = 1 THEN concat('7,{\"type\":\"rich\",\"url\":\"https://e.example.com/', CAST(turn AS STRING), "
    "'\",\"title\":\"T', CAST(conv_id AS STRING), '\",\"description\":5}') ELSE '' END, '],\"mentions\":[{\"id\":\"', CAST(1 + conv_id % 7 AS STRING), "
    "'\",\"username\":\"user', CAST(1 + conv_id % 7 AS STRING), '\",\"global_name\":', "
    "CASE WHEN conv_id % 2 = 0 THEN concat('\"Name ', CAST(1 + conv_id % 7 AS STRING), '\"') ELSE 'null' END, '}],\"referenced_message\":', "
    "CASE WHEN turn > 0 AND turn % 5 <> 4 THEN concat('{\"id\":\"', CAST(conv_id * 1000 + CAST(floor((turn - 1) / 2.0) AS BIGINT) AS STRING), "
    "'\",\"channel_id\":\"', CAST(conv_id % 30 AS STRING), '\",\"author\":{\"id\":\"77\"}}') ELSE 'null' END, '}')"
)

VIEWS: dict[str, tuple[str, list[str]]] = {
    "messages": (
        "conversations",
        [
            f"{_MESSAGE_ID} AS message_id",
            "conv_id % 30 AS channel_id",
            "conv_id % 30 % 5 AS guild_id",
            f"CAST({_AUTHOR} AS BIGINT) AS author_id",
            "role = 'system' AS is_bot",
            "CAST(TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR + turn * INTERVAL '1' MINUTE AS TIMESTAMP) AS created_at",
            "CASE WHEN turn > 0 THEN conv_id * 1000 + CAST(floor((turn - 1) / 2.0) AS BIGINT) END AS reply_to_id",
            "concat('<@', CAST(1 + conv_id % 7 AS STRING), '> ', text, ' <#', CAST(conv_id % 30 AS STRING), '>', "
            "CASE WHEN turn % 3 = 0 THEN ' `x = <@1>`' ELSE ' https://example.com/a' END) AS content",
            "text AS plain_text",
            f"{_PAYLOAD} AS payload",
            "turn",
            "conv_id",
        ],
    ),
    "channels": (
        "nation",
        [
            "CAST(n_nationkey AS BIGINT) AS channel_id",
            "CAST(n_regionkey AS BIGINT) AS guild_id",
            "n_name AS name",
            "CAST(CASE n_nationkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 10 WHEN 4 THEN 11 WHEN 5 THEN 12 ELSE 4 END AS INT) AS type",
            "CASE WHEN n_nationkey % 7 IN (3, 4, 5) THEN CAST(n_regionkey AS BIGINT) END AS parent_id",
        ],
    ),
    "guilds": ("region", ["CAST(r_regionkey AS BIGINT) AS guild_id", "r_name AS name"]),
    "vectors": (
        "embeddings",
        [
            "vec_id AS message_id",
            "embedding",
            "CAST(label AS BIGINT) AS channel_id",
            "vec_id % 5 AS guild_id",
            "CAST(TIMESTAMP '2024-01-01 00:00:00' + vec_id * INTERVAL '1' HOUR AS TIMESTAMP) AS created_at",
            "concat('t', CAST(label AS STRING)) AS tag",
        ],
    ),
    "facts": (
        "events",
        [
            "event_id AS seq",
            "CAST(ts AS TIMESTAMP) AS ts",
            "user_id AS entity_id",
            "event_type AS kind",
            "value",
            "props",
        ],
    ),
    "orders_log": (
        "orders",
        ["o_orderkey AS seq", "o_custkey AS entity_id", "o_orderstatus AS state", "CAST(o_orderdate AS TIMESTAMP) AS placed_at", "o_totalprice AS amount"],
    ),
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


def cte(*names: str) -> str:
    """The WITH clause of an oracle query over these views."""
    return "WITH " + ",\n".join(f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names) + "\n"
