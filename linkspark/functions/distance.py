"""Weighted distances of tracks and releases; Column expressions over normalised text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkspark.config import ReleaseWeights, TrackWeights
from linkspark.functions import difference as D
from linkspark.functions import text as X

#: Seconds of difference that count as none, and from which on a length counts as wholly different.
LENGTH_GRACE_S, LENGTH_MAX_S = 10, 30
#: Fixed value: steps in which the assignment measures a distance of 1.
COST_STEPS = 100_000


def length_distance(a_ms: Column, b_ms: Column) -> Column:
    """Whole seconds beyond the grace, over the maximum."""
    beyond = F.least(F.greatest(F.abs(a_ms - b_ms) - LENGTH_GRACE_S * 1000, F.lit(0)), F.lit(LENGTH_MAX_S * 1000))
    return F.floor(beyond / 1000).cast("bigint") / float(LENGTH_MAX_S)


def identifier_distance(a: Column, b: Column) -> Column:
    return D.bool_distance(X.same_identifier(a, b))


def track_number_distance(a: Column, b: Column) -> Column:
    return X.normalized_distance(X.trim_leading_zeros(a), X.trim_leading_zeros(b))


def weighted_mean(terms: list[tuple[Column, float | Column]]) -> Column:
    """Mean of the distances that are not null by their weights, left to right; null if no weight is left."""
    weights = [F.when(d.isNotNull(), F.lit(w) if not isinstance(w, Column) else w).otherwise(F.lit(0.0)) for d, w in terms]
    top = reduce(lambda a, b: a + b, [F.coalesce(d, F.lit(0.0)) * w for (d, _), w in zip(terms, weights)])
    total = reduce(lambda a, b: a + b, weights)
    return F.when(total > 0, top / total)


def weighted_mean_agg(distance: Column, weight: Column) -> Column:
    """The same over the rows of a group."""
    return F.sum(distance * weight) / F.sum(F.when(distance.isNotNull(), weight))


def track_differences(left: dict[str, Column], right: dict[str, Column]) -> dict[str, Column]:
    """Differences of title, artist, number, length (ms) and recording id; texts must be normalised before."""
    how = {"title": X.normalized_distance, "artist": X.normalized_distance, "number": track_number_distance, "length": length_distance, "recording_id": identifier_distance}
    return {k: D.difference(left[k], right[k], f) for k, f in how.items()}


def track_distance(diffs: dict[str, Column], w: TrackWeights = TrackWeights()) -> Column:
    """Total distance of two tracks: the title always counts, the rest if present on both sides."""
    return weighted_mean([
        (D.to_distance(diffs["title"]), w.track_title),
        (D.distance_if_present(diffs["artist"]), w.track_artist),
        (D.distance_if_present(diffs["number"]), w.track_number),
        (D.distance_if_present(diffs["length"]), w.track_length),
        (D.distance_if_present(diffs["recording_id"]), w.musicbrainz_recording_id),
    ])


def release_differences(left: dict[str, Column], right: dict[str, Column]) -> dict[str, Column]:
    """Differences of title, artist, id, media format, label, catalogue number and barcode of normalised texts."""
    texts = ("title", "artist", "media_format", "label", "catalog_number", "barcode")
    return {k: D.difference(left[k], right[k], X.normalized_distance) for k in texts} | {"id": D.difference(left["id"], right["id"], identifier_distance)}


def release_distance(diffs: dict[str, Column], assignment: tuple[Column, Column] | None = None, w: ReleaseWeights = ReleaseWeights()) -> Column:
    """Total distance of two releases; ``assignment`` is its distance and its number of tracks, which is its weight."""
    terms = [
        (D.to_distance(diffs["title"]), w.release_title),
        (D.distance_if_present(diffs["artist"]), w.release_artist),
        (D.distance_if_present(diffs["id"]), w.musicbrainz_release_id),
        (D.distance_if_present(diffs["media_format"]), w.media_format),
        (D.distance_if_present(diffs["label"]), w.record_label),
        (D.distance_if_present(diffs["catalog_number"]), w.catalog_number),
        (D.distance_if_present(diffs["barcode"]), w.barcode),
    ]
    return weighted_mean(terms + ([(assignment[0], assignment[1] * w.track_assignment)] if assignment else []))


def assignment_distance(matched: Column, unmatched: Column, matched_mean: Column) -> Column:
    """Mean over matched pairs and unmatched tracks, which count 1; null if there are neither."""
    n = matched + unmatched
    return F.when(n > 0, (F.coalesce(matched_mean, F.lit(0.0)) * matched + unmatched) / n)


def quantised_cost(distance: Column) -> Column:
    return F.floor(distance * COST_STEPS).cast("bigint")


def problems(missing: Column, residual: Column, left_id: Column, right_id: Column) -> Column:
    """Messages about tracks without counterpart and about an id that contradicts."""
    return F.filter(F.array(
        F.when(missing > 0, F.concat(missing.cast("string"), F.lit(" missing tracks"))),
        F.when(residual > 0, F.concat(residual.cast("string"), F.lit(" residual tracks"))),
        F.when(left_id.isNotNull() & right_id.isNotNull() & (X.trim_unicode(left_id) != X.trim_unicode(right_id)), F.lit("wrong id")),
    ), lambda x: x.isNotNull())
