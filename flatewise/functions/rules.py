"""Signature rules and stream endings as DataFrame expressions over `blocks`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIT = "struct<rule:string,observation:string,implication:string,strength:string>"


def total(name: str) -> Column:
    return F.aggregate("blocks", F.lit(0).cast("long"), lambda s, b: s + b[name])


def hit(test: Column, rule: str, observation: Column, implication: str, strength: str) -> Column:
    return F.when(test, F.struct(F.lit(rule).alias("rule"), observation.alias("observation"), F.lit(implication).alias("implication"), F.lit(strength).alias("strength")))


def signatures() -> Column:
    """The hits of all rules, in order."""
    n, matches, tokens = F.size("blocks"), total("matches"), total("n_tokens")
    stored = (n > 0) & F.forall("blocks", lambda b: b["kind"] == 0)
    full = F.size(F.filter("blocks", lambda b: b["stored_len"] == 65535))
    near = total("dist1") / F.nullif(matches, F.lit(0))
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    rules = [
        hit(stored & (full > 0), "all-stored-65535", text("all ", n, " blocks stored, ", full, " of 65535 bytes"), "stored only, as a level without compression writes it; no matching encoder", "strong"),
        hit(stored & (full == 0), "all-stored", text("all ", n, " blocks stored"), "an encoder that only stores", "moderate"),
        hit((n > 0) & F.forall("blocks", lambda b: b["kind"] == 1) & (matches > 0), "static-huffman-only", text("every block uses the fixed codes"), "a fixed-code strategy or a minimal encoder; no encoder with code tables of its own", "strong"),
        hit((tokens > 0) & (matches == 0) & (F.col("out_size") > 64), "no-lz77-matches", text("no match in ", F.col("out_size"), " bytes"), "Huffman coding without matching", "strong"),
        hit((near > 0.98) & (matches > 8), "distance-1-only", text(F.round(near * 100, 0).cast("int"), "% of matches at distance 1"), "a run-length strategy", "strong"),
        hit((n == 1) & (F.try_element_at("blocks", F.lit(1))["kind"] == 2) & (F.col("out_size") > 200000), "single-large-dynamic-block", text("one dynamic block of ", F.col("out_size"), " bytes"), "the encoder does not split large streams", "moderate"),
        hit(F.col("pad_value") != 0, "nonzero-final-padding", text("padding bits ", F.bin(F.col("pad_value"))), "most encoders pad with zeros; the padding may carry data", "moderate"),
    ]
    return F.filter(F.array(*rules), lambda h: h.isNotNull()).cast(f"array<{HIT}>")


def ending() -> Column:
    """data, flush, stored or null, from the last two blocks."""
    last, before = F.try_element_at("blocks", F.lit(-1)), F.try_element_at("blocks", F.lit(-2))
    empty = last["out_size"] == 0
    flushed = F.coalesce((before["kind"] == 0) & (F.coalesce(before["stored_len"], F.lit(0)) == 0), F.lit(False))
    return F.when(F.col("error").isNotNull() | F.col("capped") | last.isNull() | (last["final"] == 0), None).when(empty & (last["kind"] == 0), "stored").when(empty & flushed, "flush").otherwise("data")


def option_name(flags: Column) -> Column:
    """Compression option of a ZIP entry's flags."""
    bits = F.shiftright(flags, 1).bitwiseAND(3)
    return F.element_at(F.array(*map(F.lit, ("normal", "maximum", "fast", "super fast"))), bits + 1)


def encrypted(flags: Column, method: Column) -> Column:
    return (flags.bitwiseAND(65) != 0) | (method == 99)
