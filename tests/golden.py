"""A made-up label dataset of three classes, small enough to work out its weights by hand."""

IMAGES = ["a.tif", "b.tif", "c.tif", "d.tif", "e.tif", "f.tif", "held.tif"]
PIXELS = {
    1: [100, 0, 50, 0, 50, 0, 7],
    2: [0, 300, 0, 100, 0, 0, 0],
    3: [0, 0, 200, 0, 0, 600, 9],
}
HELD_OUT = ["held.tif"]
# Pixels 200, 400 and 800: shares of the inverse are 4, 2 and 1 sevenths.
INV_FREQ = [0.0, 4 / 7, 2 / 7, 1 / 7]
# 6/200 * (1 + log3(7/4)), 6/400 * (1 + log3(7/3)), 6/800 * (1 + log3(7/3)), over their sum.
CUSTOM = [0.0, 0.531882, 0.312079, 0.156039]


def counts(spark):
    rows = [(i, c, n) for c, values in PIXELS.items() for i, n in zip(IMAGES, values) if n > 0]
    return spark.createDataFrame(rows, "image string, class_id int, n bigint")
