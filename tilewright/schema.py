"""Table layouts shared by all operators.

Grid tables are long: one row per cell, keyed by ``tile_id, row_no, col_no`` with row 0 at the
top. Nodata is NULL in every band; convert NaN at the edge with :func:`functions.numeric.nodata_to_null`.
"""

from pyspark.sql import types as T

TILE, ROW, COL = "tile_id", "row_no", "col_no"
CELL_KEY = [TILE, ROW, COL]

# The seven bands of a stack, in stack order.
BANDS = ["red", "green", "blue", "reflectance", "slope", "ndrm", "density"]
RGB = BANDS[:3]
LIDAR_BANDS = BANDS[3:]

# Source class ids, names and RGBA colours of the annotation provider.
CLASSES = [
    (0, "Background", [0, 0, 0, 255]),
    (1, "Tile", [170, 109, 58, 255]),
    (2, "Dark-coloured Membrane", [102, 102, 102, 255]),
    (3, "Gravel", [160, 156, 148, 255]),
    (4, "Invalid", [0, 0, 0, 255]),
    (5, "Light-coloured Membrane", [225, 225, 225, 255]),
    (6, "Light-permitting Surface", [163, 193, 232, 255]),
    (7, "Metal", [179, 179, 179, 255]),
    (8, "Solar Panel", [41, 54, 83, 255]),
    (9, "Vegetation", [122, 144, 94, 255]),
]

# Subset names, chip edge length in cells, largest tile area in square metres.
SUBSETS = ["training", "validation", "test"]
BLOCK_SIZE = 512
MAX_TILE_AREA = 1.1e6

VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(VERTEX)


def _struct(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


TILES = _struct(("tile_id", T.StringType()), ("ring", RING), ("url", T.StringType()), ("sha256", T.StringType()))

SHEETS = _struct(
    ("kind", T.StringType()), ("tid", T.StringType()), ("url", T.StringType()),
    ("xmin", T.DoubleType()), ("ymin", T.DoubleType()), ("xmax", T.DoubleType()), ("ymax", T.DoubleType()),
)

SURFACES = _struct(
    ("tile_id", T.StringType()), ("lod", T.StringType()), ("surface_id", T.LongType()),
    ("building_id", T.StringType()), ("h50", T.DoubleType()), ("ring", RING),
)

POINTS = _struct(
    ("tile_id", T.StringType()), ("src", T.StringType()), ("idx", T.LongType()),
    ("xi", T.LongType()), ("yi", T.LongType()), ("zi", T.LongType()),
    ("x", T.DoubleType()), ("y", T.DoubleType()), ("z", T.DoubleType()), ("reflectance", T.DoubleType()),
)

GRIDS = _struct(
    ("tile_id", T.StringType()),
    ("xmin", T.DoubleType()), ("ymin", T.DoubleType()), ("xmax", T.DoubleType()), ("ymax", T.DoubleType()),
    ("res", T.DoubleType()),
)

_ASSETS = _struct(("tid", T.ArrayType(T.StringType())), ("url", T.ArrayType(T.StringType())))
MANIFEST = _struct(("tid", T.StringType()), ("image", _ASSETS), ("lidar", _ASSETS))

CLASS_TABLE = _struct(("id", T.IntegerType()), ("name", T.StringType()), ("rgba", T.ArrayType(T.IntegerType())))


def class_table(spark):
    """The provider's class dimension as a table (ten fixed rows)."""
    return spark.createDataFrame(CLASSES, CLASS_TABLE)
