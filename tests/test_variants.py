"""Layers read as VARIANT: the same targets as by schema, and a reason for every record that is none."""

import json

import pytest

from snapgrid.sources import layers, readers, schemas, variants

LAT, LON = 40.7, -74.0
POINT, LINE = [LON, LAT], [[LON, LAT], [LON + 1, LAT + 1], [LON, LAT + 2]]


def geometry(kind, coordinates, **more):
    return {"the_geom": {"type": kind, "coordinates": coordinates}, **more}


GOOD = [
    geometry("Point", POINT), geometry("MultiPoint", LINE), geometry("LineString", LINE), geometry("MultiLineString", [LINE, LINE[:2]]),
    geometry("Point", json.dumps(POINT)), geometry("LineString", json.dumps(LINE)), geometry("Polygon", [LINE]), geometry(None, POINT),
    geometry("Point", [LINE]), geometry("LineString", [[LON, LAT], [None, 1], [LON, LAT], [LON, LAT + 1]]),
]


def land(tmp_path, rows, name="pages", array=False):
    (tmp_path / name).mkdir()
    texts = [r if isinstance(r, str) else json.dumps(r) for r in rows]
    (tmp_path / name / "page.json").write_text("[" + ",\n".join(texts) + "]" if array else "\n".join(texts))
    return str(tmp_path / name)


def spots(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("flag", ["Has_Pedestrian_Ramp", "Is_Protected_Intersection", "Has_Bus_Lane"])
@pytest.mark.parametrize("array", [False, True])
def test_the_same_targets_as_by_schema(spark, tmp_path, flag, array):
    path = land(tmp_path, GOOD, array=array)
    layer = layers.LAYERS[flag]
    by_schema = layer.targets(readers.read_json_pages(spark, path, schemas.GEOMETRY_PAGE, array))
    found = variants.variant_layer(variants.read_variant_pages(spark, path, array), layer)
    assert spots(found.targets) == spots(by_schema) and found.targets.count() > 1


def test_every_record_is_targets_or_a_reject(spark, tmp_path):
    odd = [
        "{bad", '"text"', {"the_geom": None}, {"x": 1}, geometry("LineString", None), {"the_geom": {"type": "LineString"}},
        geometry("LineString", ["a", "b"]), geometry("LineString", []), geometry("Point", POINT), geometry("MultiPoint", LINE), "", "   ",
        '{"a": 1, "a": 2}',
    ]
    pages = variants.read_variant_pages(spark, land(tmp_path, [{**r, "id": k} for k, r in enumerate(GOOD)] + odd))
    layer = variants.variant_layer(pages, layers.LAYERS["Has_Bus_Lane"], {"id": ("$.id", "int")})
    reasons = {r.raw: r.reason for r in layer.rejects.collect()}
    assert reasons["{bad"] == variants.NOT_JSON and reasons['"text"'] == variants.NO_GEOMETRY
    assert reasons['{"the_geom": null}'] == reasons['{"x": 1}'] == variants.NO_GEOMETRY
    assert reasons['{"the_geom": {"type": "LineString"}}'] == variants.NO_COORDINATES
    assert reasons[json.dumps(odd[6])] == reasons[json.dumps(odd[7])] == variants.NO_NUMBERS
    assert reasons[json.dumps(odd[8])] == reasons[json.dumps(odd[9])] == variants.WRONG_KIND
    hits = {r.id for r in layer.targets.collect()}
    passed = {json.loads(raw)["id"] for raw in reasons if '"id"' in raw}
    assert hits | passed == set(range(len(GOOD))) and not hits & passed
    assert layer.rejects.count() + len(hits) == pages.count() == len(GOOD) + len(odd) - 2


def test_numbers_and_ratings(spark, tmp_path):
    places = [{"lat": "40.7", "long": -74.0}, {"lat": 40.8, "long": "-74.1"}, {"lat": "12d", "long": "1"}, {"long": 1}]
    found = variants.variant_layer(variants.read_variant_pages(spark, land(tmp_path, places)), layers.LAYERS["Has_SIP"])
    assert spots(found.targets) == [(40.7, -74.0), (40.8, -74.1)]
    assert {r.reason for r in found.rejects.collect()} == {variants.NO_NUMBERS} and found.rejects.count() == 2
    rated = [geometry("LineString", LINE, systemrating=r) for r in ("2", 3.4, 3.5, "x", None)]
    found = variants.variant_layer(variants.read_variant_pages(spark, land(tmp_path, rated, "rated")), layers.LAYERS["Has_Bad_Pavement"])
    assert found.targets.count() == 4 and [r.reason for r in found.rejects.collect()] == [variants.NOT_RATED_BAD] * 3


def test_reject_table_of_all_layers(spark, tmp_path):
    for layer in layers.LAYERS.values():
        land(tmp_path, ["{bad", {"lat": 1, "long": 2}], layer.folder)
    read = variants.read_variant_layers(spark, str(tmp_path))
    rows = variants.reject_table(read).collect()
    assert {r.flag for r in rows} == set(layers.LAYERS) and len(rows) == 2 * 13 - 4
