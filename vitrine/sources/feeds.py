"""Raw feeds as JSON texts made from the given tables: snapshots, documents, deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.sources.domain import Domain, key, signature, text, wallet


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def glue(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def snapshots(d: Domain) -> DataFrame:
    """(body): what the snapshot service says of each asset; some are missing."""
    k, c = F.col("p_partkey"), F.col
    num = k.cast("string")
    files = (F.when(k % 5 == 0, glue('[{"uri":"","mime":"image/png"},{"uri":"https://f/', num,
                                     '.mp4","mime":"video/mp4"},{"uri":"https://f/', num, '.png"}]'))
             .when(k % 5 == 1, glue('[{"uri":"https://f/', num, '.jpg","mime":"image/jpeg"}]')).otherwise(F.lit("[]")))
    links = (F.when(k % 3 == 0, glue(',"links":{"image":"https://l/', num, '.png"}'))
             .when(k % 3 == 1, F.lit(',"links":{"image":""}')).otherwise(F.lit("")))
    name = F.when(k % 9 == 0, F.lit("")).otherwise(glue('"name":', quoted(text(c("p_name"), " #", k)), ","))
    symbol = F.when(k % 6 == 0, F.lit("")).otherwise(text("S", k % 10))
    kind = quoted(c("p_type"))
    traits = (F.when(k % 8 == 0, F.lit("")).when(k % 8 == 1, F.lit(',"attributes":[]')).otherwise(glue(
        ',"attributes":[{"trait_type":"Type","value":', kind, '},{"trait_type":"Size","value":', c("p_size").cast("string"),
        '},{"trait_type":"Lit","value":true},{"trait_type":"","value":"x"},{"value":"y"},{"trait_type":"Gone","value":null},'
        '{"trait_type":"Type","value":', kind, '},{"trait_type":" Pad","value":" v "},{"trait_type":"Empty","value":""}]')))
    owner = F.when(k % 17 == 0, F.lit("")).otherwise(wallet(k))
    body = glue('{"id":', quoted(key(text("asset", k))), ',"burnt":', F.when(k % 31 == 0, "true").otherwise("false"),
                ',"ownership":{"owner":', quoted(owner), '},"content":{"json_uri":"https://chain.example.com/', num,
                '.json","files":', files, links, ',"metadata":{', name, '"symbol":', quoted(symbol), traits, "}}}")
    return d.raw("part").where(k % 29 != 0).select(body.alias("body"))


def documents(d: Domain) -> DataFrame:
    """(address, source_uri, body): fetched metadata; every fourth was not fetched."""
    k, c = F.col("p_partkey"), F.col
    num = k.cast("string")
    name = F.when(k % 10 == 0, F.lit("")).otherwise(text("Doc ", k))
    symbol = F.when(k % 7 == 0, F.lit('"symbol":"D",')).otherwise(F.lit(""))
    image = F.when(k % 3 == 0, text("https://d/", k, ".png")).otherwise(F.lit(""))
    files = F.when(k % 3 == 1, glue(',"properties":{"files":[{"uri":""},{"uri":"https://dp/', num, '.png"},{"uri":"ar://',
                                    num, '"}]}')).otherwise(F.lit(""))
    traits = (F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit(',"attributes":[]')).otherwise(glue(
        ',"attributes":[{"trait_type":"Doc","value":', (k % 50).cast("string"), '},{"trait_type":"Type","value":',
        quoted(c("p_type")), "}]")))
    body = glue('{"name":', quoted(name), ",", symbol, '"image":', quoted(image), files, traits, "}")
    address = key(text("asset", k))
    return d.raw("part").where(k % 4 != 3).select(
        k.alias("k"), address.alias("address"), glue("https://meta.example.com/", address, ".json").alias("source_uri"),
        body.alias("body"))


def delivery_bodies(d: Domain) -> DataFrame:
    """(received, body): arrays of deliveries, single ones, and unusable elements."""
    e = F.col("event_id")
    sig = signature(text("e", F.when(e % 10 == 9, e - 1).otherwise(e)))
    slot = F.floor(F.unix_timestamp("ts") / 60).cast("long")
    err = F.when(F.col("event_type") == "error", F.lit('{"Custom":1}')).otherwise(F.lit("null"))
    one = glue('{"transaction":{"signatures":[', quoted(sig), ']},"slot":', slot.cast("string"), ',"blockTime":',
               (slot * 60).cast("string"), ',"meta":{"err":', err, "}}")
    body = (F.when(e % 4 == 0, one).when(e % 5 == 0, glue("[", one, ',{"slot":5}]'))
            .when(e % 5 == 1, glue("[", one, ",7]")).otherwise(glue("[", one, "]")))
    return d.raw("events").select(e.alias("received"), body.alias("body"))


def files(d: Domain) -> DataFrame:
    """(path, content): the documents as stored files, some cut short and some no objects."""
    k = F.col("k")
    content = F.when(k % 10 == 6, F.expr("left(body, length(body) - 1)")).when(k % 10 == 2, glue("[", F.col("body"), "]")).otherwise(
        F.col("body"))
    return documents(d).select(text("meta/", k, ".json").alias("path"), F.encode(content, "UTF-8").alias("content"), "k")
