"""The feature chain: from curated columns to one vector."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VarianceThresholdSelector, VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame

from tidemill.ml.stages import DropConstant, FitCache, GeoFeatures, HeldRows, IQRClip, SeenCategories, SignedLog1p, SmoothedTargetEncoder, SteadyPCA


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns go through which step. The defaults are the curated table's: fixed values, as models depend on them."""

    clipped: tuple[str, ...] = ("DEPARTURE_DELAY", "TAXI_OUT")
    clipped_to: tuple[str, ...] = ("dep_delay_clip", "taxi_out_clip")
    logged: tuple[str, ...] = ("DISTANCE", "SCHEDULED_TIME", "GC_DISTANCE_MI")
    logged_to: tuple[str, ...] = ("log_distance", "log_sched_time", "log_gc_distance")
    imputed: tuple[str, ...] = ("SCHEDULE_SPEED_MPH", "ROUTE_DETOUR")
    encoded: tuple[str, ...] = ("ORIGIN_AIRPORT", "DESTINATION_AIRPORT", "ROUTE")
    encoded_to: tuple[str, ...] = ("te_origin", "te_dest", "te_route")
    indexed: tuple[str, ...] = ("AIRLINE",)
    indexed_to: tuple[str, ...] = ("airline_idx",)
    one_hot: tuple[str, ...] = ("airline_idx", "MONTH", "DAY_OF_WEEK", "DEP_HOUR")
    # The raw delay goes in beside the clipped one: clipping alone would bend a straight relation.
    plain: tuple[str, ...] = (
        "DEPARTURE_DELAY", "SCHEDULE_SPEED_MPH", "ROUTE_DETOUR", "SCHED_DEP_MIN", "SCHED_ARR_MIN", "WHEELS_OFF_MIN", "IS_WEEKEND", "DAY", "ORIGIN_LAT", "ORIGIN_LON", "DEST_LAT", "DEST_LON",
    )
    #: A leg's ends, distance and minutes, and what GeoFeatures makes of them; none: no such step.
    geo_from: tuple[str, ...] = ("ORIGIN_LAT", "ORIGIN_LON", "DEST_LAT", "DEST_LON", "DISTANCE", "SCHEDULED_TIME")
    geo_to: tuple[str, ...] = ("GC_DISTANCE_MI", "ROUTE_DETOUR", "SCHEDULE_SPEED_MPH")
    #: Only categories that occur get a slot, so that no selector has to drop the others; else every number up to the largest.
    seen_only: bool = True
    smoothing: float = 20.0
    iqr_error: float = 0.001


def feature_stages(label: str, use_pca: bool, k: int = 10, spec: FeatureSpec = FeatureSpec(), held: HeldRows | None = None) -> list:
    """Estimators and transformers in order; every learned one is learned inside the fit, so from training rows.

    What the fit keeps in memory belongs to held, for whoever fits to let go.
    """
    stages: list = []
    if spec.clipped:
        stages.append(IQRClip(inputCols=list(spec.clipped), outputCols=list(spec.clipped_to), relativeError=spec.iqr_error))
    if spec.geo_from:
        stages.append(GeoFeatures(inputCols=list(spec.geo_from), outputCols=list(spec.geo_to)))
    if spec.logged:
        stages.append(SignedLog1p(inputCols=list(spec.logged), outputCols=list(spec.logged_to)))
    if spec.imputed:
        stages.append(Imputer(strategy="median", inputCols=list(spec.imputed), outputCols=list(spec.imputed)))
    if spec.encoded:
        stages.append(SmoothedTargetEncoder(inputCols=list(spec.encoded), outputCols=list(spec.encoded_to), labelCol=label, smoothing=spec.smoothing))
    if spec.indexed:
        stages.append(StringIndexer(inputCols=list(spec.indexed), outputCols=list(spec.indexed_to), handleInvalid="keep"))
    hot = [f"{c.removesuffix('_idx')}_ohe" for c in spec.one_hot]
    numbers = [*spec.clipped_to, *spec.logged_to, *spec.encoded_to, *spec.plain]
    encoded = list(spec.one_hot)
    if spec.one_hot and spec.seen_only:
        encoded = [f"{c.removesuffix('_idx')}_seen" for c in spec.one_hot]
        stages.append(SeenCategories(inputCols=list(spec.one_hot), outputCols=encoded))
    if spec.one_hot:
        stages.append(OneHotEncoder(inputCols=encoded, outputCols=hot, handleInvalid="keep", dropLast=True))
    drop = DropConstant(inputCol="features_scaled", outputCol="features_selected")
    stages += [
        FitCache(held),
        VectorAssembler(inputCols=[*numbers, *hot], outputCol="features_raw", handleInvalid="keep"),
        StandardScaler(inputCol="features_raw", outputCol="features_scaled", withMean=False, withStd=True),
        drop if spec.seen_only else VarianceThresholdSelector(featuresCol="features_scaled", outputCol="features_selected", varianceThreshold=0.0),
        SteadyPCA(k=k, inputCol="features_selected", outputCol="features") if use_pca else SQLTransformer(statement="SELECT *, features_selected AS features FROM __THIS__"),
    ]
    return stages


def slot_names(df: DataFrame, column: str) -> list[str]:
    """Names of a vector column's slots, from its metadata; numbers where a slot has none."""
    attrs = df.schema[column].metadata.get("ml_attr", {})
    found = {a["idx"]: a.get("name", f"{column}_{a['idx']}") for group in attrs.get("attrs", {}).values() for a in group}
    size = attrs.get("num_attrs", max(found, default=-1) + 1)
    return [found.get(i, f"{column}_{i}") for i in range(size)]


def feature_names(model: PipelineModel, sample: DataFrame) -> list[str]:
    """Names of the slots of the final vector; components are pc_1, pc_2 and so on."""
    pca = next((s for s in model.stages if type(s).__name__ == "PCAModel"), None)
    if pca is not None:
        return [f"pc_{i + 1}" for i in range(pca.getK())]
    out, raw = sample.limit(1), []
    for stage in model.stages:
        if "features_raw" in out.columns and not raw:
            raw = slot_names(out, "features_raw")
        if type(stage).__name__ == "VarianceThresholdSelectorModel":
            return [raw[i] for i in stage.selectedFeatures]
        if isinstance(stage, VectorSlicer):
            return [raw[i] for i in stage.getIndices()]
        out = stage.transform(out)
    return raw


def importances(model: PipelineModel, names: list[str]) -> list[tuple[str, float]]:
    """Names with importances (trees) or absolute coefficients (linear models), largest first."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray()) if hasattr(last, "coefficients") else []
    return sorted(zip(names, map(float, values), strict=False), key=lambda x: (-x[1], x[0]))
