"""Queries on masks, splits, weights, metrics, losses and run ledgers."""

from pyspark.sql import functions as F

from ..functions.naming import sanitize_name
from ..functions.numeric import argmax, softmax
from ..operators.evaluation import class_metrics, confusion_matrix, macro_metrics, micro_metrics
from ..operators.labels import (
    class_count_matrix, class_counts, class_mapping, drop_invalid_class, label_classes, reindex_classes, restrict_to_split,
    verify_pairs,
)
from ..operators.losses import compound_loss, cross_entropy, region_loss
from ..operators.runs import best_run, last_run, skip_completed
from ..operators.splits import (
    assign_batches, full_class_support, js_distances, random_split, reduce_distance, stratified_split, subset_histogram,
)
from ..operators.stats import class_weights
from ..schema import CLASSES, class_table
from ..session import cut_lineage
from .registry import query
from .views import FOLD, folded

CLEAN = "clean as (select image, case when class_id = 4 then 0 else class_id end as class_id from v_mask)"


def _clean(inputs):
    return drop_invalid_class(inputs("v_mask").select("image", "class_id"), class_table(inputs.spark))


@query(
    "class_counts",
    ctes=CLEAN,
    sql="select image, cast(class_id as int) as class_id, count(*) as n from clean where class_id <> 0 group by 1, 2",
)
def class_counts_query(inputs):
    return class_counts(_clean(inputs), keep_empty=False)


@query(
    "class_matrix",
    ctes=CLEAN,
    sql="""
    select image, count(*) filter (where class_id = 1) as c1, count(*) filter (where class_id = 2) as c2,
      count(*) filter (where class_id = 7) as c7 from clean group by image""",
)
def class_matrix(inputs):
    return class_count_matrix(class_counts(_clean(inputs)), [7, 2, 1])


NAMES = "names(id, name) as (values " + ", ".join(f"({i}, '{n}')" for i, n, _ in CLASSES) + ")"


@query(
    "class_reindex",
    ctes=f"""{CLEAN}, {NAMES},
  map as (select class_id as old_id, row_number() over (order by class_id) as new_id from (select distinct class_id from clean where class_id <> 0) d)""",
    sql="""
    select image, cast(coalesce(new_id, 0) as int) as class_id, any_value(name) as old_name, count(*) as n
    from clean left join map on old_id = class_id left join names on id = class_id group by 1, 2""",
)
def class_reindex(inputs):
    mask = _clean(inputs)
    mapping = class_mapping(class_counts(mask))
    named = label_classes(mask, class_table(inputs.spark)).withColumnRenamed("name", "old_name")
    return reindex_classes(named, mapping).groupBy("image", "class_id").agg(
        F.first("old_name").alias("old_name"), F.count("*").alias("n")
    )


UNIT = "cast('0x' || substr(md5({0}), 1, 8) as bigint)/4294967296.0::double"
SPLIT = f"""
  ranked as (select {{key}} as image, row_number() over (order by {UNIT.format("'0:' || {key}")}, {{key}}) - 1 as rk,
      count(*) over () as n from {{table}}),
  sized as (select *, floor(n*0.7) as a0, floor(n*0.15) as b0, n - floor(n*0.7) - 2*floor(n*0.15) as rest from ranked),
  split as (select image, case
      when rk < a0 + floor(rest/3) + case when rest % 3 > 0 then 1 else 0 end then 'training'
      when rk < a0 + floor(rest/3) + case when rest % 3 > 0 then 1 else 0 end + b0 + floor(rest/3) + case when rest % 3 > 1 then 1 else 0 end then 'validation'
      else 'test' end as subset from sized)"""
DOC_SPLIT = SPLIT.format(key="doc_id", table="documents")
USER_COUNTS = "counts as (select image, class_id, count(*) as n from v_user_mask where class_id <> 0 group by 1, 2)"
USER_SPLIT = SPLIT.format(key="user_id", table="(select distinct user_id from events) u") + ", " + USER_COUNTS


@query("random_split", ctes=DOC_SPLIT, sql="select image as doc_id, subset from split")
def random_split_query(inputs):
    return random_split(inputs("documents"), [0.7, 0.15, 0.15], 0, key="doc_id")


@query(
    "batches",
    sql="""
    select doc_id, cast(floor(rk/8) as bigint) as batch from (
      select doc_id, row_number() over (order by doc_id) - 1 as rk, count(*) over () as n from documents) r
    where floor(rk/8) < floor(n/8)""",
)
def batches(inputs):
    return assign_batches(inputs("documents").select("doc_id"), "doc_id", 8, drop_last=True)


@query(
    "batches_shuffled",
    sql=f"""
    select doc_id, cast(floor((row_number() over (order by {UNIT.format("'0:' || doc_id")}, doc_id) - 1)/8) as bigint) as batch from documents""",
)
def batches_shuffled(inputs):
    return assign_batches(inputs("documents").select("doc_id"), "doc_id", 8, shuffle=True)


def _counts(inputs):
    return class_counts(inputs("v_user_mask"))


def _splits(inputs):
    return random_split(inputs("v_user_mask"), [0.7, 0.15, 0.15], 0)


HIST = USER_SPLIT + """,
  sums as (select s.subset, c.class_id, sum(c.n) as n from counts c join split s on s.image = c.image group by 1, 2),
  hist as (select s.subset, c.class_id, coalesce(x.n, 0) as n from (select distinct subset from split) s
    cross join (select distinct class_id from counts) c left join sums x on x.subset = s.subset and x.class_id = c.class_id),
  share as (select subset, class_id, n, n/sum(n) over (partition by subset) as s, n/sum(n) over (partition by class_id) as g from hist)"""


@query(
    "subset_hist",
    ctes=HIST,
    sql="""
    select subset, cast(class_id as int) as class_id, cast(n as bigint) as n, round(s, 6) as local_share, round(g, 6) as global_share
    from share""",
)
def subset_hist(inputs):
    counts, splits = _counts(inputs), _splits(inputs)
    local = subset_histogram(counts, splits, "local").withColumn("local_share", F.round("share", 6)).drop("share")
    overall = subset_histogram(counts, splits, "global").select(
        "subset", "class_id", F.round("share", 6).alias("global_share")
    )
    return local.join(overall, ["subset", "class_id"])


JS = HIST + """,
  pair as (select a.subset as this, b.subset as that, a.s as p, b.s as q, (a.s + b.s)/2 as m
    from share a join share b on a.class_id = b.class_id and a.subset < b.subset),
  js as (select this, that, sqrt(sum(case when p > 0 then p*ln(p/m) else 0 end + case when q > 0 then q*ln(q/m) else 0 end)/(2*ln(count(*)))) as distance
    from pair group by 1, 2)"""


@query("js_distance", ctes=JS, sql="select this, that, round(distance, 6) as distance from js")
def js_distance(inputs):
    out = js_distances(subset_histogram(_counts(inputs), _splits(inputs)))
    return out.withColumn("distance", F.round("distance", 6))


@query(
    "js_reduced",
    ctes=JS,
    sql="""
    select 'avg' as how, round(avg(distance), 6) as distance from js union all
    select 'max', round(max(distance), 6) from js union all select 'sum', round(sum(distance), 6) from js""",
)
def js_reduced(inputs):
    pairs = js_distances(subset_histogram(_counts(inputs), _splits(inputs)))
    parts = [
        reduce_distance(pairs, how).select(F.lit(how).alias("how"), F.round("distance", 6).alias("distance"))
        for how in ("avg", "max", "sum")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("split_support", ctes=HIST, sql="select subset, min(n) > 0 as full_support from hist group by subset")
def split_support(inputs):
    return full_class_support(_counts(inputs), _splits(inputs))


@query("stratified_split")
def stratified_split_query(inputs):
    return stratified_split(_counts(inputs), [0.7, 0.15, 0.15])


@query(
    "stratified_balance",
    ctes=JS + """,
  total as (select count(distinct image) as n from v_user_mask),
  kept as (select cast(floor(n*0.7) as bigint) as a, cast(floor(n*0.15) as bigint) as b, n from total)""",
    sql="""
    select subset, case subset when 'training' then a + cast(ceil((n - a - 2*b)/3) as bigint) when 'validation' then b + cast(ceil((n - a - 2*b - 1)/3) as bigint)
        else b + cast(floor((n - a - 2*b)/3) as bigint) end as images,
      true as full_support, (select round(avg(distance), 6) from js) as random_distance, true as closer
    from kept cross join (values ('training'), ('validation'), ('test')) v(subset)""",
)
def stratified_balance(inputs):
    """Sizes and class support of the stratified split, and whether its subsets are closer than those of a random split."""
    counts = _counts(inputs)
    split = cut_lineage(stratified_split(counts, [0.7, 0.15, 0.15], trials=8))
    apart = lambda s: reduce_distance(js_distances(subset_histogram(counts, s))).scalar()
    sizes = split.groupBy("subset").agg(F.countDistinct("image").alias("images"))
    return sizes.join(full_class_support(counts, split), "subset").select(
        "subset", "images", "full_support", F.round(apart(_splits(inputs)), 6).alias("random_distance"), (apart(split) < apart(_splits(inputs))).alias("closer")
    )


@query(
    "training_counts",
    ctes=USER_SPLIT,
    sql="""
    select c.image, cast(class_id as int) as class_id, n from counts c join split s on s.image = c.image where subset = 'training'""",
)
def training_counts(inputs):
    return restrict_to_split(class_counts(inputs("v_user_mask"), keep_empty=False), _splits(inputs), "training")


@query(
    "weights_inv_freq",
    ctes=USER_COUNTS + ", raw as (select class_id, (select sum(n) from counts)/sum(n) as w from counts group by 1)",
    sql="""
    select 0 as class_id, 0::double as w union all
    select cast(class_id as int), round(w/(select sum(w) from raw), 6) from raw""",
)
def weights_inv_freq(inputs):
    return class_weights(_counts(inputs), "inv_freq").withColumn("w", F.round("w", 6))


@query(
    "weights_custom",
    ctes=USER_COUNTS + """,
  k as (select count(distinct image)::double as images, (select count(distinct class_id) from counts)::double as classes from v_user_mask),
  raw as (select class_id, images/sum(n)*(ln((images + 1)/(count(*) + 1))/ln(classes) + 1) as w from counts, k group by class_id, images, classes)""",
    sql="""
    select 0 as class_id, 0::double as w union all
    select cast(class_id as int), round(w/(select sum(w) from raw), 6) from raw""",
)
def weights_custom(inputs):
    return class_weights(_counts(inputs)).withColumn("w", F.round("w", 6))


CONF = """
  axis as (select unnest(range(5)) as c),
  conf as (select s.stage, cast(t.c as int) as truth, cast(p.c as int) as pred, coalesce(n, 0) as n
    from (select distinct stage from v_scored) s cross join axis t cross join axis p
    left join (select stage, truth, pred, count(*) as n from v_scored {where} group by 1, 2, 3) x
      on x.stage = s.stage and x.truth = t.c and x.pred = p.c)"""
ALL, KEPT = CONF.format(where=""), CONF.format(where="where truth <> 0")


def _share(over: str) -> str:
    return f"round(case when sum(n) over ({over}) = 0 then 0 else n/sum(n) over ({over}) end, 6)"


@query(
    "confusion_matrix",
    ctes=ALL,
    sql=f"""
    select stage, truth, pred, cast(n as bigint) as n, {_share('partition by stage, truth')} as by_truth,
      {_share('partition by stage, pred')} as by_pred, {_share('partition by stage')} as by_all from conf""",
)
def confusion_matrix_query(inputs):
    scored, key = inputs("v_scored"), ["stage", "truth", "pred"]
    shares = {
        name: confusion_matrix(scored, 5, how).select(*key, "n", F.round("share", 6).alias(name))
        for name, how in (("by_truth", "true"), ("by_pred", "pred"), ("by_all", "all"))
    }
    return shares["by_truth"].join(shares["by_pred"].drop("n"), key).join(shares["by_all"].drop("n"), key)


PER_CLASS = """,
  pc as (select stage, c, sum(case when truth = c and pred = c then n else 0 end) as tp,
      sum(case when truth <> c and pred = c then n else 0 end) as fp,
      sum(case when truth = c and pred <> c then n else 0 end) as fn from conf cross join axis group by 1, 2),
  met as (select stage, cast(c as int) as class_id, coalesce(tp/nullif(tp + fn, 0), 0) as accuracy, coalesce(2*tp/nullif(2*tp + fp + fn, 0), 0) as f1,
      coalesce(tp/nullif(tp + fp + fn, 0), 0) as jaccard, coalesce(tp/nullif(tp + fp, 0), 0) as precision,
      coalesce(tp/nullif(tp + fn, 0), 0) as recall from pc)"""
FIVE = ["accuracy", "f1", "jaccard", "precision", "recall"]
ROUNDED = ", ".join(f'round("{m}", 6) as "{m}"' for m in FIVE)


def _rounded(df):
    return df.withColumns({m: F.round(m, 6) for m in FIVE})


@query("class_metrics", ctes=KEPT + PER_CLASS, sql=f"select stage, class_id, {ROUNDED} from met")
def class_metrics_query(inputs):
    return _rounded(class_metrics(confusion_matrix(inputs("v_scored"), 5, ignore=0)))


@query(
    "macro_metrics",
    ctes=KEPT + PER_CLASS,
    sql="select stage, " + ", ".join(f'round(avg("{m}"), 6) as "{m}"' for m in FIVE) + " from met where class_id <> 0 group by stage",
)
def macro_metrics_query(inputs):
    return _rounded(macro_metrics(confusion_matrix(inputs("v_scored"), 5, ignore=0), 0))


@query(
    "micro_metrics",
    ctes=KEPT + PER_CLASS,
    sql="""
    select stage, round(sum(tp)/sum(tp + fn), 6) as accuracy, round(2*sum(tp)/sum(2*tp + fp + fn), 6) as f1,
      round(sum(tp)/sum(case when c <> 0 then tp + fp + fn end), 6) as jaccard, round(sum(tp)/sum(tp + fp), 6) as "precision",
      round(sum(tp)/sum(tp + fn), 6) as recall from pc group by stage""",
)
def micro_metrics_query(inputs):
    return _rounded(micro_metrics(confusion_matrix(inputs("v_scored"), 5, ignore=0), 0))


SOFT = f"""
  score as (select vec_id, cast(vec_id % 7 as int) as image, cast(label as int) as truth, cast(i - 1 as int) as class_id, {FOLD.format("i", 10)} as s
    from (select vec_id, label, embedding, unnest(range(1, 11)) as i from embeddings) e),
  top as (select *, max(s) over (partition by vec_id) as m from score),
  soft as (select vec_id, image, truth, class_id, exp(s - m)/sum(exp(s - m)) over (partition by vec_id) as p,
    (class_id + 1)/55.0::double as w from top)"""
WEIGHTS = [(c + 1) / 55.0 for c in range(10)]


def _soft(inputs):
    return _scored(inputs).select("vec_id", "image", "truth", softmax(F.col("scores")).alias("probs"))


def _scored(inputs):
    """Ten class scores per vector, each the sum of every tenth of its components."""
    return inputs("embeddings").select(
        "vec_id", (F.col("vec_id") % 7).cast("int").alias("image"), F.col("label").cast("int").alias("truth"), folded("embedding", 10).alias("scores"),
    )


@query(
    "softmax_argmax",
    ctes=SOFT,
    sql="select vec_id, cast(arg_max(class_id, p) as int) as label, round(max(p), 6) as top from soft group by 1",
)
def softmax_argmax(inputs):
    return _soft(inputs).select("vec_id", argmax(F.col("probs")).alias("label"), F.round(F.array_max("probs"), 6).alias("top"))


CE = """,
  pixel as (select vec_id, truth, max(case when class_id = truth then w end) as wy,
      max(case when class_id = truth then -w*ln(p) end) as nll, sum(-w*ln(p)) as spread from soft group by 1, 2),
  ce as (select sum(nll*0.9::double + spread*0.1::double/10)/sum(wy) as loss from pixel where truth <> 0)"""
DICE = """,
  part as (select image, class_id, sum(case when truth = class_id then p else 0 end) as tp, sum(p) as p, sum(case when truth = class_id then 1 else 0 end) as y
    from soft where class_id > 0 group by 1, 2),
  dice as (select avg(1 - (2*tp + 1e-5)/(p + y + 1e-5)) as loss from part)"""


@query("cross_entropy", ctes=SOFT + CE, sql="select round(loss, 6) as loss from ce")
def cross_entropy_query(inputs):
    out = cross_entropy(_soft(inputs), WEIGHTS, 0.1, include_background=False)
    return out.select(F.round("loss", 6).alias("loss"))


@query("cross_entropy_scores", ctes=SOFT + CE, sql="select round(loss, 6) as loss from ce")
def cross_entropy_scores(inputs):
    """As ``cross_entropy``, from scores by log-sum-exp."""
    out = cross_entropy(_scored(inputs), WEIGHTS, 0.1, include_background=False)
    return out.select(F.round("loss", 6).alias("loss"))


@query(
    "region_losses",
    ctes=SOFT + DICE + """,
  gd as (select avg(1 - (2*a + 1e-5)/(b + 1e-5)) as loss from (
    select image, sum(w*tp) as a, sum(w*(p + y)) as b from (
      select *, coalesce(1.0/nullif(y*y, 0), max(1.0/nullif(y*y, 0)) over (partition by image)) as w from part) x group by image) g),
  tv as (select avg(1 - (tp + 1e-5)/(tp + 0.5*(p - tp) + 0.5*(y - tp) + 1e-5)) as loss from part),
  fo as (select sum(case when class_id = truth and truth > 0 then -power(1 - p/(1 - p0), 2)*ln(p/(1 - p0)) else 0 end)/(count(distinct vec_id)*9) as loss
    from (select *, max(case when class_id = 0 then p end) over (partition by vec_id) as p0 from soft) f)""",
    sql="""
    select 'diceloss' as kind, round(loss, 6) as loss from dice union all
    select 'generalizeddiceloss', round(loss, 6) from gd union all
    select 'tverskyloss', round(loss, 6) from tv union all select 'focalloss', round(loss, 6) from fo""",
)
def region_losses(inputs):
    soft, out = _soft(inputs), None
    for kind in ("diceloss", "generalizeddiceloss", "tverskyloss", "focalloss"):
        loss = region_loss(soft, kind, include_background=False)
        row = loss.select(F.lit(kind).alias("kind"), F.round("loss", 6).alias("loss"))
        out = row if out is None else out.unionByName(row)
    return out


# Ten by ten pixels an image, in order of vec_id.
PLACED = """,
  hp as (select *, vec_id // 100 as im, vec_id % 100 // 10 as r, vec_id % 10 as c from soft where class_id > 0),
  masks as (select im, class_id, r, c, 0 as mask, p > 0.5 as inside from hp union all select im, class_id, r, c, 1, truth = class_id from hp),
  far as (select a.im, a.class_id, a.mask, a.r, a.c, min((a.r - b.r)*(a.r - b.r) + (a.c - b.c)*(a.c - b.c)) as d2
    from masks a join masks b on a.im = b.im and a.class_id = b.class_id and a.mask = b.mask and a.inside <> b.inside group by all),
  reach as (select im, class_id, sum(d2) as far from far group by all),
  err as (select im, class_id, count(*) as n, sum(power(p - case when truth = class_id then 1 else 0 end, 2)) as error from hp group by all),
  hd as (select sum(error*coalesce(far, 0)/n)/sum(n) as loss from err left join reach using (im, class_id))"""


def _placed(inputs):
    at = F.col("vec_id")
    return _soft(inputs).withColumns({
        "image": F.floor(at / 100), "row_no": F.floor(at % 100 / 10).cast("int"), "col_no": (at % 10).cast("int"),
    })


@query("hausdorff_loss", ctes=SOFT + PLACED, sql="select round(loss, 6) as loss from hd")
def hausdorff_loss(inputs):
    return region_loss(_placed(inputs), "hausdorffdtloss", include_background=False).select(F.round("loss", 6).alias("loss"))


@query("compound_hausdorff", ctes=SOFT + CE + PLACED, sql="select round(ce.loss + 0.25*hd.loss, 6) as loss from ce, hd")
def compound_hausdorff(inputs):
    """Cross entropy and a share of the Hausdorff loss."""
    out = compound_loss(_placed(inputs), ["CrossEntropyLoss", "HausdorffDTLoss"], [1.0, 0.25], WEIGHTS, include_background=False, smoothing=0.1)
    return out.select(F.round("loss", 6).alias("loss"))


@query(
    "compound_loss",
    ctes=SOFT + CE + DICE,
    sql="select round(ce.loss + 0.5*dice.loss, 6) as loss from ce, dice",
)
def compound_loss_query(inputs):
    out = compound_loss(
        _soft(inputs), ["crossentropyloss", "diceloss"], [1.0, 0.5], WEIGHTS, include_background=False, smoothing=0.1
    )
    return out.select(F.round("loss", 6).alias("loss"))


@query(
    "compound_loss_scores",
    ctes=SOFT + CE + DICE,
    sql="select round(ce.loss + 0.5*dice.loss, 6) as loss from ce, dice",
)
def compound_loss_scores(inputs):
    """As ``compound_loss``, from scores by log-sum-exp."""
    out = compound_loss(
        _scored(inputs), ["crossentropyloss", "diceloss"], [1.0, 0.5], WEIGHTS, include_background=False, smoothing=0.1
    )
    return out.select(F.round("loss", 6).alias("loss"))


@query(
    "best_run",
    sql="""
    select param_a, run_no, objective, last_no from (
      select *, row_number() over (partition by param_a order by objective desc, run_no) as k,
        max(run_no) over (partition by param_a) as last_no from v_runs) r where k = 1""",
)
def best_run_query(inputs):
    runs = inputs("v_runs")
    best = best_run(runs, "objective", "run_no", by=["param_a"]).select("param_a", "run_no", "objective")
    last = last_run(runs, "run_no", by=["param_a"]).select("param_a", F.col("run_no").alias("last_no"))
    return best.join(last, "param_a")


@query(
    "skip_completed",
    sql="""
    select c.run_no, c.param_a, c.param_b, d.cached from v_runs c left join (
      select param_a, param_b, arg_max(objective, run_no) as cached from v_runs where state = 'COMPLETE' group by 1, 2) d
      on d.param_a = c.param_a and d.param_b = c.param_b""",
)
def skip_completed_query(inputs):
    runs = inputs("v_runs")
    candidates = runs.select("run_no", "param_a", "param_b")
    return skip_completed(candidates, runs, ["param_a", "param_b"], "objective", "run_no")


@query(
    "verify_pairs",
    ctes=DOC_SPLIT,
    sql="""
    select concat(cast(image as string), '.tif') as image, subset, 'no mask' as reason from split where image not in (select doc_id from labels)""",
)
def verify_pairs_query(inputs):
    file = lambda suffix: F.concat(F.col("doc_id").cast("string"), F.lit(suffix)).alias("image")
    splits = random_split(inputs("documents"), [0.7, 0.15, 0.15], 0, key="doc_id").select(file(".tif"), "subset")
    return verify_pairs(inputs("documents").select(file(".tif")), inputs("labels").select(file(".png")), splits)


@query(
    "name_cleanup",
    sql="""
    select page_id, concat(regexp_replace(url, '^.*/', ''), '.tif') as name from pages""",
)
def name_cleanup(inputs):
    exported = F.concat(F.col("url"), F.lit("_png.rf."), F.md5("url"), F.lit(".png"))
    return inputs("pages").select("page_id", sanitize_name(exported).alias("name"))
