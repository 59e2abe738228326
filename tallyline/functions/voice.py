"""Voice quality and number functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Of the E-model for G.711 with concealment the best rating, the part that loss can take away and the
# robustness to it, and the cubic from a rating r to a score; and the same as SQL for both engines.
G711_BEST, G711_LOSSY, G711_ROBUST = 93.2062077233, 95.0, 17.2647
G711_CUBIC = (2.06405, 0.031738, -0.000356641, 2.93143e-6)
G711_RATING_SQL = f"{G711_BEST}{{d}} - {G711_LOSSY}{{d}} * (loss * 100 / (loss * 100 / burst + {G711_ROBUST}{{d}}))"
G711_CUBIC_SQL = " + ".join(f"{x}{{d}}" + " * r" * k for k, x in enumerate(G711_CUBIC))


def mos_g711(loss: Column, burst: Column) -> Column:
    """Mean opinion score for G.711 with concealment: loss as a share of packets, burst as its burst ratio.

    The E-model's rating falls with the effective loss and a cubic maps it to 1 to 4.5.
    """
    p = loss * 100
    r = F.lit(G711_BEST) - F.lit(G711_LOSSY) * (p / (p / burst + G711_ROBUST))
    a, b, c, d = map(F.lit, G711_CUBIC)
    cubic = a + b * r + c * r * r + d * r * r * r
    return F.when((loss == 0) | (burst == 0), 4.5).when(loss > 0.5, 1.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(4.5), cubic)))


def mos_e_model(loss: Column, burst: Column, impairment: float = 11.0, robustness: float = 19.0) -> Column:
    """The same by the public E-model formula for any codec; the defaults are those of G.729A with concealment."""
    p = loss * 100
    r = F.lit(93.2) - (F.lit(impairment) + (F.lit(95.0) - impairment) * p / (p / F.greatest(burst, F.lit(1.0)) + robustness))
    mos = F.lit(1.0) + F.lit(0.035) * r + r * (r - 60) * (F.lit(100.0) - r) * F.lit(7e-6)
    return F.when(r <= 0, 1.0).otherwise(F.least(F.lit(4.5), mos))


def packet_loss_pct(lost: Column, received: Column) -> Column:
    return lost / (received + 2 + lost) * 100


#: Middles of the delay classes in milliseconds.
DELAY_MIDDLES = [60, 80, 105, 135, 175, 250, 300]


def delay_sum(counts: list[Column]) -> Column:
    out = F.lit(0)
    for n, middle in zip(counts, DELAY_MIDDLES):
        out += n * middle
    return out


def loss_and_burst(histogram: Column, received: Column) -> tuple[Column, Column]:
    """(loss share, burst ratio) from an array whose n-th entry counts runs of n lost packets.

    Fewer than five lost packets count as none; the ratio is at least 1.
    """
    lost = F.aggregate(F.transform(histogram, lambda n, i: n * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    runs = F.aggregate(histogram, F.lit(0).cast("bigint"), lambda a, x: a + x)
    share = F.when(lost < 5, 0.0).otherwise(lost / (received + lost))
    ratio = F.when(lost < 5, 0.0).otherwise(F.greatest(F.lit(1.0), (lost / runs) * (1 - lost / (received + lost))))
    return share, ratio


def normalize_number(number: Column, skip: list[str], international: list[str], local_country: str, minimum: int = 9, rounds: int = 3, exclude: list[str] = ()) -> Column:
    """Without skip prefixes, the longest that fits, up to `rounds` times, and without the international prefix; a local
    number gets its country before it. A number that begins with an excluded prefix stays as it is.
    """
    without = lambda n, p: F.substring(n, len(p) + 1, 64)

    def once(n: Column) -> Column:
        out = n
        for p in sorted(skip, key=len):  # the last, longest one decides
            out = F.when(n.startswith(p), without(n, p)).otherwise(out)
        return out

    out = number
    for _ in range(rounds if skip else 0):
        out = once(out)
    foreign, bare, stays = F.lit(False), out, F.lit(False)
    for p in sorted(international, key=len):
        foreign |= out.startswith(p)
        bare = F.when(out.startswith(p), without(out, p)).otherwise(bare)
    for p in exclude:
        stays |= number.startswith(p)
    digits = F.regexp_replace(bare, r"^[0+]+", "")
    return F.when(stays, number).when(foreign | (F.length(digits) >= minimum), digits).otherwise(F.concat(F.lit(local_country), digits))


def normalize_response(text: Column) -> Column:
    """Response text without addresses, call ids and numbers that only occur once."""
    out = F.regexp_replace(text, r"\d{1,3}(\.\d{1,3}){3}(:\d+)?", "<ip>")
    out = F.regexp_replace(out, r"\S+@\S+", "<id>")
    return F.trim(F.regexp_replace(out, r"\b\d{4,}\b", "<n>"))


def energy_level(payload: Column, codec: Column) -> Column:
    """The mean absolute sample of G.711 bytes (an array of integers): u-law for codec 0, A-law for 8, and 0 for others.

    Both laws give a magnitude of four bits of mantissa shifted by three bits of exponent; an empty payload gives 0.
    """

    def u_law(byte: Column) -> Column:
        b = byte.bitwiseXOR(F.lit(255))
        return F.call_function("shiftleft", b.bitwiseAND(15) * 8 + 132, F.shiftright(b.bitwiseAND(112), 4)) - 132

    def a_law(byte: Column) -> Column:
        b = byte.bitwiseXOR(F.lit(85))
        mantissa, exponent = b.bitwiseAND(15) * 16, F.shiftright(b.bitwiseAND(112), 4)
        return F.when(exponent == 0, mantissa + 8).otherwise(F.call_function("shiftleft", mantissa + 264, exponent - 1))

    def mean(law) -> Column:
        total = F.aggregate(F.transform(payload, law), F.lit(0).cast("bigint"), lambda a, v: a + v)
        return F.floor(F.try_divide(total, F.size(payload))).cast("bigint")

    zero = F.lit(0).cast("bigint")
    return F.coalesce(F.when(codec == 0, mean(u_law)).when(codec == 8, mean(a_law)), zero)
