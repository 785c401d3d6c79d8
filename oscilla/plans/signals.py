"""Queries on signals: windows, bags of waveforms, TF-IDF, spectra, filters, vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import kernels, tabular
from ..operators import bags, spectra, vectors, windows
from ..sources import signals as src
from ..sources import tables
from . import workflows
from .registry import CODES, LONG, SIGNAL, SPECTRA, VECTORS, registry, rounded

QUERIES, ORACLES, query = registry()
DOCS = ["subject", "seg"]


@query("win_tumbling", f"with {SIGNAL} select subject, t // 8 as win, count(*) as n, round(sum(x), 6) as sum_x, min(x) as min_x, max(x) as max_x from signal group by all having count(*) = 8")
def win_tumbling(spark, d):
    return windows.tumbling(src.signal(spark, d), 8).withColumn("sum_x", rounded("sum_x"))


@query("win_sliding", f"with {SIGNAL} select subject, t as start, round(s, 6) as sum_x from (select subject, t, sum(x) over w as s, count(*) over w as n from signal window w as (partition by subject order by t rows between current row and 7 following)) where n = 8")
def win_sliding(spark, d):
    return windows.sliding(src.signal(spark, d), 8).withColumn("sum_x", rounded("sum_x"))


@query("win_sliding_arrays", f"with {SIGNAL}, p as (select subject, list(x order by t) as s from signal group by subject) select subject, start, round(list_sum(s[start + 1 : start + 8]), 6) as sum_x from (select subject, s, unnest([0, 5, 60]) as start from p) where start + 8 <= len(s)")
def win_sliding_arrays(spark, d):
    out = windows.sliding_arrays(src.packed(src.signal(spark, d)), 8, [0, 5, 60])
    return out.select("subject", F.col("start").cast("long"), rounded(F.aggregate("w", F.lit(0.0), lambda s, x: s + x)).alias("sum_x"))


@query("win_random", f"""with {SIGNAL}, p as (select subject, list(x order by t) as s, greatest(count(*) - 7, 0) as n, least(greatest(count(*) - 7, 0), 3) as m from signal group by subject),
h as (select *, list_transform([0, 1, 2], lambda i: case when i < m then cast('0x' || substr(md5(concat_ws(':', subject, i, 13)), 1, 15) as bigint) % (n - m + i + 1) end) as t from p),
a as (select *, t[1] as a0, case when t[2] = t[1] then n - m + 1 else t[2] end as a1 from h), b as (select *, case when t[3] in (a0, a1) then n - m + 2 else t[3] end as a2 from a),
o as (select subject, s, unnest([a0, a1, a2]) as start from b) select subject, start, round(list_sum(s[start + 1 : start + 8]), 6) as sum_x from o where start is not null""")
def win_random(spark, d):
    out = windows.random_offsets(src.packed(src.signal(spark, d)), 8, 3, seed=13)
    return out.select("subject", F.col("start").cast("long"), rounded(F.aggregate("w", F.lit(0.0), lambda s, x: s + x)).alias("sum_x"))


@query("win_overlap50", f"""with {SIGNAL}, s as (select *, count(*) over (partition by subject) as n from signal),
e as (select subject, x, n, unnest([t // 8 - 1, t // 8]) as seg from s)
select subject, seg, round(sum(x), 6) as sum_x from e where seg >= 0 and seg < 2 * (n // 16) - 1 group by all""")
def win_overlap50(spark, d):
    return windows.half_overlapping(src.signal(spark, d), 16).withColumn("sum_x", rounded("sum_x"))


@query("seg_prefix", f"with {SIGNAL} select length, subject, count(*) as n, round(sum(x), 6) as sum_x from signal, (values (8), (24), (64)) v(length) where t < length group by all")
def seg_prefix(spark, d):
    return windows.prefixes(src.signal(spark, d), [8, 24, 64]).withColumn("sum_x", rounded("sum_x"))


@query("window_counts", f"with {LONG} select subject, count(*) as n_points, cast(ceil(count(*) / 24.0) as bigint) as n_windows from long group by all")
def window_counts(spark, d):
    sizes = src.long_series(spark, d).groupBy("subject").agg(F.count("*").alias("n_points"))
    return sizes.select("subject", "n_points", windows.window_count(F.col("n_points"), srate=16.0, seconds=1.5).alias("n_windows"))


@query("pack_unpack", f"with {SIGNAL} select subject, t, x from signal")
def pack_unpack(spark, d):
    return src.unpacked(src.packed(src.signal(spark, d)))


_BAG = f"""{CODES}, c as (select *, code + book * 16 as feature, t // 8 as seg, (max(t) over (partition by subject) + 1) // 8 as n_whole from codes),
bag as (select subject, seg, feature, count(*) as n, count(*) / 8.0::double as rate from c where seg < n_whole group by all)"""


@query("bow_counts", f"with {_BAG} select subject, seg, feature, n from bag")
def bow_counts(spark, d):
    return bags.bag(src.codes(spark, d), per_segment=8, k=src.K, rates=False)


@query("bow_rates", f"with {_BAG} select subject, seg, feature, n, round(rate, 6) as rate from bag")
def bow_rates(spark, d):
    return bags.bag(src.codes(spark, d), per_segment=8, k=src.K).withColumn("rate", rounded("rate"))


def _whole(norm: str):
    def run(spark, d):
        counts = bags.bag(src.codes(spark, d), per_segment=None, k=src.K).withColumn("book", F.floor(F.col("feature") / src.K).cast("int"))
        return counts.select("subject", "book", "feature", rounded(bags.normed(counts.withColumn("v", F.col("n").cast("double")), ["subject", "book"], "n", norm)).alias("v"))

    return run


for _norm, _sql in (("l1", "sum(n) over w"), ("l2", "sqrt(sum(n * n) over w)"), ("max", "max(n) over w")):
    query(f"bow_whole_{_norm}", f"with {CODES}, b as (select subject, book, code + book * 16 as feature, cast(count(*) as double) as n from codes group by all) select subject, book, feature, round(n / {_sql}, 6) as v from b window w as (partition by subject, book)")(_whole(_norm))


def _tfidf(**how):
    return lambda spark, d: bags.tfidf(bags.bag(src.codes(spark, d), per_segment=8, k=src.K), DOCS, **how).withColumn("w", rounded("w"))


def _tfidf_sql(norm: str | None = "l2", use_idf: bool = True, smooth_idf: bool = True, sublinear_tf: bool = False) -> str:
    tf = "1 + ln(rate)" if sublinear_tf else "rate"
    one = 1 if smooth_idf else 0
    weight = f"({tf}) * (ln((nd + {one})::double / (df + {one})) + 1)" if use_idf else tf
    over = {"l2": "sqrt(sum(v * v) over w)", "l1": "sum(abs(v)) over w", None: None}[norm]
    value = f"coalesce(v / nullif({over}, 0), 0)" if over else "v"
    return f"""with {_BAG}, f as (select feature, count(*) as df from bag where rate > 0 group by feature), n as (select count(*) as nd from (select distinct subject, seg from bag)),
v as (select subject, seg, feature, {weight} as v from bag join f using (feature), n) select subject, seg, feature, round({value}, 6) as w from v window w as (partition by subject, seg)"""


for _name, _how in {
    "tfidf_l2": {}, "tfidf_l1": {"norm": "l1"}, "tfidf_none": {"norm": None}, "tfidf_sublinear": {"sublinear_tf": True}, "tfidf_nosmooth": {"smooth_idf": False}, "tf_only": {"use_idf": False}, "bow_tfidf_l2": {},
}.items():
    query(_name, _tfidf_sql(**_how))(_tfidf(**_how))


@query("idf_table", f"with {_BAG} select feature, count(*) as df, round(ln((1 + (select count(*) from (select distinct subject, seg from bag)))::double / (1 + count(*))) + 1, 6) as idf from bag where rate > 0 group by feature")
def idf_table(spark, d):
    return bags.idf(bags.bag(src.codes(spark, d), per_segment=8, k=src.K), DOCS).withColumn("idf", rounded("idf"))


@query("feature_concat", f"""with {_BAG}, {SIGNAL}, m as (select subject, t // 8 as seg, avg(x) as v from signal group by all having count(*) = 8)
select subject, seg, feature, round(v, 6) as v from (select subject, seg, feature, rate as v from bag union all select subject, seg, 32, v from m) x
where exists (select 1 from m where m.subject = x.subject and m.seg = x.seg) and exists (select 1 from bag where bag.subject = x.subject and bag.seg = x.seg)""")
def feature_concat(spark, d):
    left = bags.bag(src.codes(spark, d), per_segment=8, k=src.K).select(*DOCS, "feature", F.col("rate").alias("v"))
    right = windows.tumbling(src.signal(spark, d), 8).select("subject", F.col("win").alias("seg"), F.lit(0).alias("feature"), (F.col("sum_x") / 8).alias("v"))
    return bags.joined_features(left, right, DOCS, shift=2 * src.K).withColumn("v", rounded("v"))


# --- spectra

_MEAN = f"{SPECTRA}, mean as (select subject, bin, avg(p) as p from spectra group by all)"
_UNIT = f"{_MEAN}, unit as (select subject, bin, p / sum(p) over (partition by subject) as p from mean)"


@query("psd_channel_mean", f"with {_MEAN} select subject, bin, round(p, 6) as p from mean")
def psd_channel_mean(spark, d):
    return spectra.channel_mean(src.spectra(spark, d)).withColumn("p", rounded("p"))


_BARY = {
    "normed": f"with {_UNIT} select bin, round(avg(p), 6) as p from unit group by bin",
    "unnormed": f"with {_MEAN} select bin, round(avg(p), 6) as p from mean group by bin",
    "joint": f"with {SPECTRA}, u as (select subject, channel, bin, p / sum(p) over (partition by subject) as p from spectra), m as (select subject, bin, avg(p) as p from u group by all) select bin, round(avg(p), 6) as p from m group by bin",
    "wasserstein": f"with {_UNIT} select bin, round(pow(avg(sqrt(p)), 2), 6) as p from unit group by bin",
}
for _kind, _sql in _BARY.items():
    query(f"bary_{_kind}", _sql)(lambda spark, d, kind=_kind: spectra.barycenter(src.spectra(spark, d), kind).withColumn("p", rounded("p")))

_SIDES = "targets as (select * from {0} where subject % 2 = 1), sources as (select * from {0} where subject % 2 = 0)"


def _sides(spark, d):
    mean = spectra.channel_mean(src.spectra(spark, d))
    return mean.where("subject % 2 = 1"), mean.where("subject % 2 = 0")


def _nearest_sql(table: str, scale: float) -> str:
    return f"""with {_UNIT}, {_SIDES.format(table)}, g as (select a.subject as target, b.subject as source, round(sqrt(sum(pow(sqrt(a.p) - sqrt(b.p), 2)) * {scale}::double), 9) as dist from targets a join sources b using (bin) group by all),
r as (select *, row_number() over (partition by target order by dist, source) as k from g) select target, source, round(dist, 6) + 0 as dist from r where k = 1"""


@query("hellinger_match", _nearest_sql("unit", 0.5))
def hellinger_match(spark, d):
    return spectra.nearest(*_sides(spark, d)).withColumn("dist", rounded("dist"))


@query("l2_match", _nearest_sql("mean", 1.0))
def l2_match(spark, d):
    return spectra.nearest(*_sides(spark, d), metric="l2").withColumn("dist", rounded("dist"))


_FILTER = f"{_UNIT}, bary as (select bin, avg(p) as p from unit group by bin), flt as (select subject, bin, sqrt(bary.p) / sqrt(unit.p) as h from unit join bary using (bin))"


def _bary_filter(spark, d):
    unit = spectra.unit_mass(spectra.channel_mean(src.spectra(spark, d)), ["subject"])
    return spectra.frequency_filter(unit, spectra.barycenter(src.spectra(spark, d)))


@query("cmmn_filter_bary", f"with {_FILTER} select subject, bin, round(h, 6) as h from flt")
def cmmn_filter_bary(spark, d):
    return _bary_filter(spark, d).withColumn("h", rounded("h"))


@query("cmmn_filter_s2s", f"""with {_UNIT}, {_SIDES.format("unit")}, g as (select a.subject as target, b.subject as source, round(sqrt(sum(pow(sqrt(a.p) - sqrt(b.p), 2)) * 0.5::double), 9) as dist from targets a join sources b using (bin) group by all),
r as (select *, row_number() over (partition by target order by dist, source) as k from g)
select t.subject, t.bin, round(sqrt(s.p) / sqrt(t.p), 6) as h from r join mean t on t.subject = r.target join mean s on s.subject = r.source and s.bin = t.bin where k = 1""")
def cmmn_filter_s2s(spark, d):
    targets, sources = _sides(spark, d)
    return spectra.matched_filter(targets, sources, spectra.nearest(targets, sources)).withColumn("h", rounded("h"))


_TAPS = f"{_FILTER}, taps as (select subject, k, sum(case when bin in (0, 11) then 1 else 2 end * h * cos(2 * pi() / 22 * ((bin * k) % 22))) / 22 as h from flt, (select unnest(range(22)) as k) group by all)"


@query("irfft_taps", f"with {_TAPS} select subject, cast(k as integer) as k, round(h, 6) as h from taps")
def irfft_taps(spark, d):
    return spectra.taps(_bary_filter(spark, d), 12).withColumn("h", rounded("h"))


_SIGNAL_TAPS = f"{SIGNAL}, taps as (select subject, k, case k when 0 then 0.5 when 1 then 0.3 when 2 then 0.2 end::double / (1 + subject % 3) as h from (select distinct subject from signal), (select unnest(range(3)) as k))"


def _signal_taps(spark, d):
    shape = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(h).alias("h")) for k, h in enumerate((0.5, 0.3, 0.2))])).alias("s")
    return src.signal(spark, d).select("subject").distinct().select("subject", shape).select("subject", "s.k", (F.col("s.h") / (1 + F.col("subject") % 3)).alias("h"))


@query("fir_causal", f"with {_SIGNAL_TAPS} select s.subject, s.t, round(sum(p.x * h), 6) as y from signal s join taps using (subject) join signal p on p.subject = s.subject and p.t = s.t - k group by all")
def fir_causal(spark, d):
    return spectra.causal_fir(src.signal(spark, d), _signal_taps(spark, d)).withColumn("y", rounded("y"))


@query("fir_per_channel", f"with {_SIGNAL_TAPS} select subject, t % 3 as channel, t, round(x * h, 6) as y from signal join taps using (subject) where k = t % 3")
def fir_per_channel(spark, d):
    gains = _signal_taps(spark, d).select("subject", F.col("k").cast("long").alias("channel"), "h")
    return spectra.channel_gain(src.signal(spark, d).withColumn("channel", F.col("t") % 3), gains).withColumn("y", rounded("y"))


@query("periodogram", f"""with {SIGNAL}, w as (select *, t // 16 as win, t % 16 as j, count(*) over (partition by subject, t // 16) as n from signal),
s as (select subject, win, bin, sum(x * cos(2 * pi() / 16 * ((bin * j) % 16))) as re, sum(x * sin(2 * pi() / 16 * ((bin * j) % 16))) as im from w, (select unnest(range(9)) as bin) where n = 16 group by all)
select subject, win, cast(bin as integer) as bin, round(re * re + im * im, 4) as power from s""")
def periodogram(spark, d):
    return spectra.periodogram(src.signal(spark, d), 16, 9).withColumn("power", rounded("power", 4))


@query("autocorr_norm", f"""with {SIGNAL}, p as (select a.subject, b.t - a.t as lag, sum(a.x * b.x) as s from signal a join signal b on a.subject = b.subject and b.t - a.t between 0 and 8 group by all)
select subject, cast(lag as integer) as lag, round(s / max(case when lag = 0 then s end) over (partition by subject), 6) as r from p""")
def autocorr_norm(spark, d):
    return spectra.autocorrelation(src.signal(spark, d), 8).withColumn("r", rounded("r"))


@query("minmax_scale", f"with {_MEAN} select subject, bin, round(0.99::double * ((p - min(p) over w) / (max(p) over w - min(p) over w) * 2 - 1), 6) + 0 as v from mean window w as (partition by subject)")
def minmax_scale(spark, d):
    mean = spectra.channel_mean(src.spectra(spark, d))
    return mean.select("subject", "bin", rounded(0.99 * spectra.min_max(mean, ["subject"], "p")).alias("v"))


@query("notch_undo", f"""with {_MEAN}, a as (select subject, bin, case when bin = 4 and lag(p) over w - p > 0.5 and lead(p) over w - p > 0.5 then (lag(p) over w + lead(p) over w) / 2 else p end as p from mean window w as (partition by subject order by bin)),
b as (select subject, bin, case when bin = 9 and lag(p) over w - p > 0.5 and lead(p) over w - p > 0.5 then (lag(p) over w + lead(p) over w) / 2 else p end as p from a window w as (partition by subject order by bin)) select subject, bin, round(p, 6) as p from b""")
def notch_undo(spark, d):
    return spectra.notch_undo(spectra.channel_mean(src.spectra(spark, d)), [4, 9], gap_db=0.5).withColumn("p", rounded("p"))


@query("psd_median_db", f"with {SPECTRA} select subject, bin, round(20 * log10(median(p)), 6) as db from spectra group by all")
def psd_median_db(spark, d):
    return src.spectra(spark, d).groupBy("subject", "bin").agg(rounded(spectra.decibel(F.median("p"), 20.0)).alias("db"))


@query("psd_db", f"with {_MEAN} select subject, bin, round(10 * log10(p), 6) as db from mean")
def psd_db(spark, d):
    return spectra.channel_mean(src.spectra(spark, d)).select("subject", "bin", rounded(spectra.decibel(F.col("p"))).alias("db"))


@query("polysomnograph", f"with {SIGNAL} select subject, t, round(x / max(abs(x)) over (partition by subject), 6) as y from signal where t >= 8 and t < 40")
def polysomnograph(spark, d):
    part = src.signal(spark, d).where("t >= 8 and t < 40")  # the range that is shown, of every subject
    return part.select("subject", "t", rounded(F.col("x") / F.max(F.abs("x")).over(Window.partitionBy("subject"))).alias("y"))


@query("matmul_unmix", f"""with {SIGNAL}, w as (select ic, subject as channel, cos(ic * subject) as w from (select distinct subject from signal), (select unnest(range(4)) as ic))
select cast(ic as integer) as ic, t, round(sum(w * x), 4) as x from w join signal on subject = channel group by all""")
def matmul_unmix(spark, d):
    samples = src.signal(spark, d).select(F.col("subject").alias("channel"), "t", "x")
    ics = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ic")
    weights = src.signal(spark, d).select(F.col("subject").alias("channel")).distinct().select("channel", ics).select("ic", "channel", F.cos(F.col("ic") * F.col("channel")).alias("w"))
    return spectra.unmixed(weights, samples).withColumn("x", rounded("x", 4))


@query("matrix_chain", """with a as (select p_size % 6 as i, p_partkey % 7 as k, sum(p_retailprice) as v from part group by all), b as (select p_partkey % 7 as k, p_size % 4 as j, sum(p_retailprice / 1000) as v from part group by all)
select i, j, round(sum(a.v * b.v), 2) as v from a join b using (k) group by all""")
def matrix_chain(spark, d):
    part = src.table(spark, d, "part")
    a = part.groupBy((F.col("p_size") % 6).alias("i"), (F.col("p_partkey") % 7).alias("k")).agg(F.sum("p_retailprice").alias("v"))
    b = part.groupBy((F.col("p_partkey") % 7).alias("k"), (F.col("p_size") % 4).alias("j")).agg(F.sum(F.col("p_retailprice") / 1000).alias("v"))
    return spectra.matrix_product(a, b).withColumn("v", rounded("v", 2))


# --- numeric kernels on packed series; the SQL has the same by sums


def _values(series, index: str = "i", digits: int = 6):
    return series.select(*[c for c in series.columns if c != "values"], F.posexplode("values").alias(index, "v")).withColumn("v", rounded("v", digits))


_WELCH = f"""with {LONG}, n as (select subject, count(*) as n from long group by subject),
s as (select subject, seg, t - 32 * seg as j, x - avg(x) over (partition by subject, seg) as x, n from (select *, unnest([t // 32 - 1, t // 32]) as seg from long) join n using (subject) where seg >= 0 and 32 * seg + 64 <= n),
f as (select subject, seg, bin, sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 64)) * cos(2 * pi() / 64 * ((bin * j) % 64))) as re, sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 64)) * sin(2 * pi() / 64 * ((bin * j) % 64))) as im
  from s, (select unnest(range(33)) as bin) group by all),
w as (select subject, bin, avg((re * re + im * im) / (64 * 24) * case when bin in (0, 32) then 1 else 2 end) as p from f group by all)"""


@query("welch_psd", f"{_WELCH} select subject, cast(bin as integer) as i, round(p, 6) as v from w")
def welch_psd(spark, d):
    return _values(kernels.per_series(src.packed(src.long_series(spark, d)), kernels.welch_kernel(fs=64, nperseg=64)))


#: The series of the frames' SQL: channels in the place of subjects, or the mean of a subject's channels.
_TWO = LONG.replace("long as (", "pair as (", 1).replace("l_quantity as x", "l_quantity as a, l_tax * 100 as b")
_FRAME_SIGNALS = _WELCH.replace(LONG, _TWO + ", long as (select subject, t, (a + b) / 2 as x from pair)")
_FRAME_SPECTRA = _WELCH.replace(LONG, _TWO + ", long as (select subject * 2 as subject, t, a as x from pair union all select subject * 2 + 1, t, b from pair)")


@query("frame_of_signals", f"{_FRAME_SIGNALS} select subject, cast(bin as integer) as bin, round(10 * log10(p), 6) as db from w")
def frame_of_signals(spark, d):
    return workflows.spectrum_frame(src.channels(spark, d), srate=64, nperseg=64).withColumn("db", rounded("db"))


@query("frame_of_spectra", f"{_FRAME_SPECTRA} select subject // 2 as subject, cast(bin as integer) as bin, round(10 * log10(avg(p)), 6) as db from w group by all")
def frame_of_spectra(spark, d):
    return workflows.spectrum_frame(src.channels(spark, d), srate=64, nperseg=64, average="spectra").withColumn("db", rounded("db"))


@query("welch_normed", f"{_WELCH} select subject, cast(bin as integer) as i, round(p / sum(p) over (partition by subject), 6) as v from w")
def welch_normed(spark, d):
    return _values(kernels.per_series(src.packed(src.long_series(spark, d)), kernels.welch_kernel(fs=64, nperseg=64, normalize=True)))


def _lowpass_sql(up: int, down: int) -> str:
    """Taps (i, h) of the resampling filter: a windowed sinc, the window a ratio of Bessel functions by their series."""
    most = max(up, down)
    bessel = "list_sum(list_transform(range(25), lambda k: pow({0} / 4, k) / pow(factorial(k::integer)::double, 2)))"
    return f"""g as (select i, case when i = {10 * most} then 1 else sin(pi() * (i - {10 * most}) / {most}) / (pi() * (i - {10 * most}) / {most}) end / {most} * {bessel.format(f"(25 * (1 - pow((i - {10 * most}) / {10.0 * most}::double, 2)))")} as h
  from (select unnest(range({20 * most + 1})) as i)), taps as (select i, h / sum(h) over () * {up} as h from g)"""


def _resample_sql(table: str, up: int, down: int) -> str:
    """(subject, i, v): ``table`` (subject, t, x, n) resampled to ceil(n up / down) samples."""
    half = 10 * max(up, down)
    return f"""o as (select subject, x, n, t, unnest(range((t * {up} - {half}) // {down} - 1, (t * {up} + {half}) // {down} + 2)) as i from {table}),
y as (select subject, o.i, sum(x * h) as v from o join taps on taps.i = o.i * {down} - t * {up} + {half} where o.i >= 0 and o.i < ceil(n * {up} / {down}::double) group by all)"""


_FEATURES = f"""with {LONG}, n as (select subject, count(*) as n from long group by subject),
ps as (select subject, seg, t - 32 * seg as j, x * (0.54 - 0.46 * cos(2 * pi() * (t - 32 * seg) / 63)) as x from (select *, unnest([t // 32 - 1, t // 32]) as seg from long) join n using (subject) where seg >= 0 and seg < 2 * (n // 64) - 1),
f as (select subject, seg, bin, sum(x * cos(2 * pi() / 64 * ((bin * j) % 64))) as re, sum(x * sin(2 * pi() / 64 * ((bin * j) % 64))) as im from ps, (select unnest(range(1, 33)) as bin) group by all),
w2 as (select sum(pow(0.54 - 0.46 * cos(2 * pi() * j / 63), 2)) as w2 from (select unnest(range(64)) as j)),
md as (select subject, bin, 20 * log10(median((re * re + im * im) * 2 / (64 * w2) * case when bin = 32 then 0.5 else 1 end)) as db from f, w2 group by all),
psd as (select subject, i, 0.99 * ((db - min(db) over w) / (max(db) over w - min(db) over w) * 2 - 1) as v from md join (select unnest(range(100)) as i) on bin = least(i + 1, 32) window w as (partition by subject)),
sg as (select subject, seg, t - 96 * seg as j, x from (select *, unnest([t // 96 - 1, t // 96]) as seg from long) join n using (subject) where seg >= 0 and seg < 2 * (n // 192) - 1),
ls as (select a.subject, b.j - a.j as lag, sum(a.x * b.x) as s from sg a join sg b on a.subject = b.subject and a.seg = b.seg and b.j - a.j between 0 and 64 group by all),
ac as (select subject, lag as t, s / max(case when lag = 0 then s end) over (partition by subject) / ((192 - lag) / 192.0::double) as x, 65 as n from ls),
{_lowpass_sql(100 // 4, 64 // 4)}, {_resample_sql("ac", 25, 16)}"""


@query("iclabel_features", f"""{_FEATURES} select subject, cast(i as integer) as i, round(cast(cast(v as real) as double), 4) + 0 as v from psd
union all select subject, cast(99 + i as integer), round(cast(cast(0.99 * v as real) as double), 4) + 0 from y where i between 1 and 100""")
def iclabel_features(spark, d):
    return _values(kernels.per_series(src.packed(src.long_series(spark, d)), kernels.feature_kernel(fs=64)), digits=4)


@query("iclabel_features_sql", f"""{_FEATURES} select subject, cast(i as integer) as i, round(cast(cast(v as real) as double), 4) + 0 as v from psd
union all select subject, cast(99 + i as integer), round(cast(cast(0.99 * v as real) as double), 4) + 0 from y where i between 1 and 100""")
def iclabel_features_sql(spark, d):
    """The same by a table function in Spark's SQL."""
    tabular.register(spark)
    found = spark.sql("select * from series_features(table({long}) partition by (subject) order by (t), 64.0D, 'features')", long=src.long_series(spark, d))
    return found.withColumn("v", rounded("v", 4))


#: The features' SQL by segment: whole segments of 256 samples are series of their own, too short for averaged autocorrelations.
_SHORT = _FEATURES.replace("sg as (select subject, seg, t - 96 * seg as j, x from (select *, unnest([t // 96 - 1, t // 96]) as seg from long) join n using (subject) where seg >= 0 and seg < 2 * (n // 192) - 1)", "sg as (select subject, 0 as seg, t as j, x from long)")
_BY_SEGMENT = _SHORT.replace(" / ((192 - lag) / 192.0::double)", "").replace(LONG, LONG.replace("long as (", "whole as (", 1) + """, long as (select subject * 1000 + t // 256 as subject, t % 256 as t, x
from (select *, max(t) over (partition by subject) + 1 as n from whole) where (t // 256 + 1) * 256 <= n)""")


@query("iclabel_features_by_segment", f"""{_BY_SEGMENT}, found as (select subject, cast(i as integer) as i, round(cast(cast(v as real) as double), 4) + 0 as v from psd
union all select subject, cast(99 + i as integer), round(cast(cast(0.99 * v as real) as double), 4) + 0 from y where i between 1 and 100) select subject // 1000 as subject, subject % 1000 as seg, i, v from found""")
def iclabel_features_by_segment(spark, d):
    full = windows.segments(src.long_series(spark, d), 256)
    by = src.long_series(spark, d).withColumn("seg", full).groupBy("subject", "seg").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("s")).where(F.size("s") == 256)
    found = kernels.per_series(by.select("subject", "seg", F.transform("s", lambda s: s["x"]).alias("samples")), kernels.feature_kernel(fs=64))
    return found.select("subject", "seg", F.posexplode("values").alias("i", "v")).withColumn("v", rounded("v", 4))


_SIZED = f"{SIGNAL}, sized as (select *, count(*) over (partition by subject) as n from signal)"


@query("resample_poly", f"with {_SIZED}, {_lowpass_sql(125, 64)}, {_resample_sql('sized', 125, 64)} select subject, cast(i as integer) as i, round(v, 6) + 0 as v from y")
def resample_poly(spark, d):
    return _values(kernels.per_series(src.packed(src.signal(spark, d)), lambda x: kernels.resampled(x, 125, 64)))


@query("resample_smooth", f"""with {_SIZED}, ends as (select subject, n, max(case when t = 0 then x end) as a, max(case when t = 1 then x end) as b, max(case when t = n - 2 then x end) as y, max(case when t = n - 1 then x end) as z from sized group by all),
wide as (select subject, t, x, n from sized union all select subject, -k, a - (b - a) * k, n from ends, (select unnest(range(1, 12)) as k) union all select subject, n - 1 + k, z + (z - y) * k, n from ends, (select unnest(range(1, 12)) as k)),
{_lowpass_sql(125, 64)}, {_resample_sql('wide', 125, 64)} select subject, cast(i as integer) as i, round(v, 6) + 0 as v from y""")
def resample_smooth(spark, d):
    return _values(kernels.per_series(src.packed(src.signal(spark, d)), lambda x: kernels.resampled(x, 125, 64, smooth_ends=True)))


@query("fir_centered", f"with {SIGNAL} select s.subject, cast(s.t as integer) as i, round(sum(p.x * h), 6) as v from signal s, (values (0, 0.5::double), (1, 0.3::double), (2, 0.2::double)) taps(k, h) join signal p on p.subject = s.subject and p.t = s.t + 1 - k group by all")
def fir_centered(spark, d):
    return _values(kernels.per_series(src.packed(src.signal(spark, d)), lambda x: kernels.centered(x, np.array([0.5, 0.3, 0.2]))))


@query("fir_packed", f"with {_SIGNAL_TAPS}, y as (select s.subject, s.t, sum(p.x * case k when 0 then 0.5 when 1 then 0.3 else 0.2 end::double) as y from signal s join taps using (subject) join signal p on p.subject = s.subject and p.t = s.t - k group by all) select subject, t, round(y, 6) as y from y")
def fir_packed(spark, d):
    out = kernels.per_series(src.packed(src.signal(spark, d)), lambda x: kernels.causal(x, [0.5, 0.3, 0.2]))
    return out.select("subject", F.posexplode("values").alias("t", "y")).select("subject", F.col("t").cast("long").alias("t"), rounded("y").alias("y"))


_RESPONSE = [1.0, 0.9, 0.6, 0.2, 0.05]


@query("spectral_filter", f"""with {SIGNAL}, r as (select unnest(range(5)) as bin, sqrt(unnest({_RESPONSE}::double[])) as m), taps as (select k, sum(m * case when bin in (0, 4) then 1 else 2 end * cos(2 * pi() / 8 * ((bin * k) % 8))) / 8 as h from r, (select unnest(range(8)) as k) group by k),
once as (select s.subject, s.t, sum(p.x * h) as x from signal s, taps join signal p on p.subject = s.subject and p.t = s.t - k group by all)
select s.subject, cast(s.t as integer) as i, round(sum(p.x * h), 6) + 0 as v from once s, taps join once p on p.subject = s.subject and p.t = s.t + k group by all""")
def spectral_filter(spark, d):
    return _values(kernels.per_series(src.packed(src.signal(spark, d)), lambda x: kernels.spectral_filtering(x, _RESPONSE, kind="zero-phase")))


# --- vectors

_BOOK = f"{VECTORS}, book as (select label as class, r - 1 as centroid, {{0}} as c from (select *, row_number() over (partition by label order by id) as r from vec) where r <= 2)"


@query("nearest_cosine", f"""with {_BOOK.format('v')}, g as (select id, class, centroid, round(1 - list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c))), 9) as dist from vec, book), r as (select *, row_number() over (partition by id, class order by dist, centroid) as k from g)
select id, class, cast(centroid as integer) as centroid, round(dist, 6) + 0 as dist from r where k = 1""")
def nearest_cosine(spark, d):
    return vectors.nearest_centroid(src.vectors(spark, d), src.codebook(spark, d)).withColumn("dist", rounded("dist"))


@query("nearest_sqeuclid", f"""with {_BOOK.format('v')}, g as (select id, class, centroid, round(list_distance(v, c) * list_distance(v, c), 9) as dist from vec, book), r as (select *, row_number() over (partition by id, class order by dist, centroid) as k from g)
select id, class, cast(centroid as integer) as centroid, round(dist, 6) + 0 as dist from r where k = 1""")
def nearest_sqeuclid(spark, d):
    return vectors.nearest_centroid(src.vectors(spark, d), src.codebook(spark, d), "euclidean").withColumn("dist", rounded("dist"))


_SHIFTED = f"""{_BOOK.format('v[1:48]')}, g as (select id, class, centroid, s, round(1 - list_dot_product(v[s + 1 : s + 48], c) / (sqrt(list_dot_product(v[s + 1 : s + 48], v[s + 1 : s + 48])) * sqrt(list_dot_product(c, c))), 9) as dist from vec, book, (select unnest(range(17)) as s)),
r as (select *, row_number() over (partition by id, class order by dist, centroid, s) as k from g), best as (select id, class, cast(centroid as integer) as centroid, cast(s as integer) as shift, dist from r where k = 1)"""


@query("si_assign", f"with {_SHIFTED} select id, class, centroid, shift, round(dist, 6) + 0 as dist from best")
def si_assign(spark, d):
    return vectors.shifted_nearest(src.vectors(spark, d), src.codebook(spark, d, length=48)).withColumn("dist", rounded("dist"))


@query("si_assign_euclid", f"""{'with ' + _SHIFTED.replace("round(1 - list_dot_product(v[s + 1 : s + 48], c) / (sqrt(list_dot_product(v[s + 1 : s + 48], v[s + 1 : s + 48])) * sqrt(list_dot_product(c, c))), 9)", "round(pow(list_distance(v[s + 1 : s + 48], c), 2), 9)")} select id, class, centroid, shift, round(dist, 6) + 0 as dist from best""")
def si_assign_euclid(spark, d):
    return vectors.shifted_nearest(src.vectors(spark, d), src.codebook(spark, d, length=48), "euclidean").withColumn("dist", rounded("dist"))


@query("centroid_spread", f"with {_BOOK.format('v[1:48]')} select class, cast(centroid as integer) as centroid, round(list_var_pop(c), 6) as var from book")
def centroid_spread(spark, d):
    return vectors.centroid_spread(src.codebook(spark, d, length=48)).withColumn("var", rounded("var"))


def _batched(spark, d):
    """Assignments of all vectors to the two centroids of each class, in batches."""
    books: dict[int, list] = {}
    for r in src.codebook(spark, d, length=48).orderBy("class", "centroid").collect():
        books.setdefault(r["class"], []).append(r.c)
    return vectors.assigned(src.vectors(spark, d), {label: np.array(own) for label, own in books.items()})


def _own_book(spark, d):
    """The same with the centroids of all classes numbered through."""
    return _batched(spark, d).withColumn("centroid", F.col("class") * 2 + F.col("centroid"))


_OWN = f"{_SHIFTED}, own as (select id, class * 2 + centroid as centroid, shift, dist from best)"


@query("si_assign_batched", f"with {_SHIFTED} select id, class, centroid, shift, round(dist, 6) + 0 as dist from best")
def si_assign_batched(spark, d):
    return _batched(spark, d).withColumn("dist", rounded("dist"))


@query("si_update", f"""with {_OWN}, l as (select centroid, unnest(range(48)) as pos, v, shift from own join vec using (id)) , m as (select centroid, pos, avg(v[shift + pos + 1]) as m, count(*) as n from l group by all)
select cast(k.c as integer) as centroid, cast(p.p as integer) as pos, round(coalesce(m, 0), 6) as m, coalesce(n, 0) as n from (select unnest(range(21)) as c) k cross join (select unnest(range(48)) as p) p left join m on m.centroid = k.c and m.pos = p.p""")
def si_update(spark, d):
    both = _own_book(spark, d).join(src.vectors(spark, d), "id")
    out = vectors.centroid_update(both, 48, 21)  # the last cluster is empty
    return out.select("centroid", "n", F.posexplode("c").alias("pos", "m")).select("centroid", "pos", rounded("m").alias("m"), "n")


@query("si_norms", f"with {VECTORS} select id, cast(s as integer) as shift, round(list_dot_product(v[s + 1 : s + 48], v[s + 1 : s + 48]), 6) as norm2 from vec, (select unnest(range(17)) as s)")
def si_norms(spark, d):
    return vectors.shifted_norms(src.vectors(spark, d), 48).withColumn("norm2", rounded("norm2"))


@query("si_inertia", f"with {_OWN} select round(sum(dist), 4) as inertia, count(distinct centroid) as clusters from own")
def si_inertia(spark, d):
    return vectors.inertia(_own_book(spark, d)).withColumn("inertia", rounded("inertia", 4))


@query("cluster_sizes", f"with {_OWN} select centroid, count(*) as n from own group by centroid order by n desc, centroid")
def cluster_sizes(spark, d):
    return _own_book(spark, d).groupBy("centroid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "centroid")


@query("nearest_members", f"with {_OWN}, ranked as (select centroid, id, row_number() over (partition by centroid order by round(dist, 9), id) as k from own) select centroid, k, id from ranked where k <= 3")
def nearest_members(spark, d):
    order = [rounded("dist", 9), F.col("id")]
    kept = windows.capped(_own_book(spark, d), ["centroid"], order, 3)
    return kept.select("centroid", F.row_number().over(Window.partitionBy("centroid").orderBy(*order)).cast("long").alias("k"), "id")


#: Fixed draws of the seeding query: the first centroid has one trial, the others three.
DRAWS = [[0.37], [0.11, 0.52, 0.93], [0.28, 0.64, 0.81]]


def _seeds_sql() -> str:
    """Greedy seeding unrolled: of all windows and shifts of the trials' rows the one of least potential, by trial, shift and window."""
    gap = "pow(list_distance(c.v[w.w + 1 : w.w + 48], n.v[s.s + 1 : s.s + 48]), 2)"
    parts = [VECTORS, "near0 as (select id, v, 'inf'::double as near from vec)", "w as (select unnest(range(17)) as w)", "s as (select unnest(range(17)) as s)"]
    for k, draws in enumerate(DRAWS):
        size = "1.0::double" if not k else "near"
        parts += [
            f"upto{k} as (select id, v, sum({size}) over (order by id) as upto, sum({size}) over () as total from near{k})",
            f"cand{k} as (" + " union all ".join(f"(select {t} as trial, id, v from upto{k} where upto >= {r} * total order by id limit 1)" for t, r in enumerate(draws)) + ")",
            f"pot{k} as (select c.trial, c.id, s.s, w.w, sum(least(n.near, {gap})) as p from cand{k} c, w, s, near{k} n group by all)",
            f"best{k} as (select * from pot{k} order by round(p, 6), trial, s, w limit 1)",
            f"near{k + 1} as (select n.id, n.v, least(n.near, pow(list_distance(c.v[b.w + 1 : b.w + 48], n.v[b.s + 1 : b.s + 48]), 2)) as near from near{k} n, best{k} b join cand{k} c on c.trial = b.trial)",
        ]
    return "with " + ", ".join(parts) + " " + " union all ".join(f"select {k} as centroid, id, cast(w as integer) as \"window\", cast(s as integer) as shift, round(p, 4) as potential from best{k}" for k in range(len(DRAWS)))


@query("si_seeds", _seeds_sql())
def si_seeds(spark, d):
    """Shift-invariant greedy seeding over all windows of all vectors, with fixed draws."""
    _, how = vectors.greedy_seeds(src.vectors(spark, d), len(DRAWS), 48, DRAWS)
    return spark.createDataFrame([(k, *own[:3], round(own[3], 4)) for k, own in enumerate(how)], "centroid int, id long, window int, shift int, potential double")


def _rounds_sql(rounds: int = 2) -> str:
    """Assignments and means unrolled from the first four vectors' beginnings; the round of least inertia stays."""
    gap = "round(1 - list_dot_product(v[s + 1 : s + 48], c) / (sqrt(list_dot_product(v[s + 1 : s + 48], v[s + 1 : s + 48])) * sqrt(list_dot_product(c, c))), 9)"
    parts = [VECTORS, "s as (select unnest(range(17)) as s)", "c0 as (select row_number() over (order by id) - 1 as k, v[1:48] as c from vec where id in (select id from vec order by id limit 4))"]
    for r in range(rounds + 1):
        parts.append(f"a{r} as (select id, k, s, dist from (select *, row_number() over (partition by id order by dist, k, s) as n from (select id, k, s, {gap} as dist from vec, c{r}, s)) where n = 1)")
        parts.append(f"m{r} as (select k, p, avg(v[s + p + 1]) as m from (select k, s, v, unnest(range(48)) as p from a{r} join vec using (id)) group by all)")
        parts.append(f"c{r + 1} as (select c{r}.k, coalesce(list(m order by p) filter (m is not null), list_transform(range(48), lambda i: 0.0::double)) as c from c{r} left join m{r} on m{r}.k = c{r}.k group by c{r}.k)")
    totals = " union all ".join(f"select {r} as r, sum(dist) as total from a{r}" for r in range(rounds + 1))
    every = " union all ".join(f"select {r} as r, * from a{r}" for r in range(rounds + 1))
    parts += [f"t as ({totals})", f"every as ({every})"]
    return "with " + ", ".join(parts) + " select id, cast(k as integer) as centroid, cast(s as integer) as shift, round(dist, 6) + 0 as dist from every where r = (select r from t order by total, r limit 1)"


@query("si_kmeans_rounds", _rounds_sql())
def si_kmeans_rounds(spark, d):
    """Two rounds of shift-invariant k-means from given centroids, and the assignments of the best of them."""
    vec = src.vectors(spark, d)
    start = np.array([r.v[:48] for r in vec.orderBy("id").limit(4).collect()])
    _, found, _ = vectors.shift_kmeans(vec, 4, 48, init=start, max_iter=2)
    return found.withColumn("dist", rounded("dist"))


@query("si_kmeans_fit")
def si_kmeans_fit(spark, d):
    centers, found, _ = vectors.shift_kmeans(src.vectors(spark, d), 4, 48, max_iter=4, n_init=1)
    return found.groupBy("centroid").agg(F.count("*").alias("n"), rounded(F.sum("dist"), 4).alias("inertia")).withColumn("norm", rounded(F.lit(float(np.linalg.norm(centers))), 4))


@query("kmeans_plus_plus_fit")
def kmeans_plus_plus_fit(spark, d):
    """k-means|| starts over all vectors, euclidean."""
    _, found, _ = vectors.shift_kmeans(src.vectors(spark, d), 4, 48, metric="euclidean", init="k-means++", max_iter=2)
    return found.groupBy("centroid").agg(F.count("*").alias("n"))


# --- files: written to the shared folder and read back


@query("codebook_files", f"with {_BOOK.format('v[1:48]')} select class, cast(centroid as integer) as centroid, round(list_sum(c), 6) as sum_c from book")
def codebook_files(spark, d):
    path = tables.new_path(spark, "codebooks")
    tables.write_codebooks(src.codebook(spark, d, length=48), path)
    book = tables.read_codebooks(spark, path)
    return book.select("class", "centroid", rounded(F.aggregate("c", F.lit(0.0), lambda s, x: s + x)).alias("sum_c"))


@query("cached_windows", f"with {SIGNAL} select subject, t // 8 as win, count(*) as n, round(sum(x), 6) as sum_x from signal group by all having count(*) = 8")
def cached_windows(spark, d):
    """Built and written at first, loaded by its parameters the second time."""
    root = tables.new_path(spark, "cache")

    def build():
        return windows.tumbling(src.signal(spark, d), 8).select("subject", "win", "n", rounded("sum_x").alias("sum_x"))

    def fail():
        raise AssertionError("the cache was not found")

    tables.build_or_load(spark, root, "windows", build, folder=d, length=8)
    return tables.build_or_load(spark, root, "windows", fail, folder=d, length=8)


@query("spectra_files", f"with {_MEAN} select subject, bin, round(p, 6) as p from mean")
def spectra_files(spark, d):
    path = tables.new_path(spark, "spectra")
    tables.write_by_subject(spectra.channel_mean(src.spectra(spark, d)), path)
    return tables.read_by_subject(spark, path, "subject bin p").withColumn("p", rounded("p"))


@query("filters_by_subject", f"with {SIGNAL} select subject, count(*) as n, round(sum(x) * (0.5 + subject % 3), 6) as y from signal group by subject")
def filters_by_subject(spark, d):
    series = src.packed(src.signal(spark, d))
    path = tables.new_path(spark, "filters")
    tables.write_by_subject(series.select("subject", F.array((0.5 + F.col("subject") % 3).cast("double")).alias("taps")), path)
    both = tables.with_filters(series, tables.read_by_subject(spark, path, "subject taps"))
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)
    return both.select("subject", F.size("samples").cast("long").alias("n"), rounded(total * F.col("taps")[0]).alias("y"))
