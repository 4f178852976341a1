"""Result types of Arrow functions, as objects: a type given as text would need a session at import."""

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

STRING, INT, LONG, DOUBLE, FLOAT, BOOL = StringType(), IntegerType(), LongType(), DoubleType(), FloatType(), BooleanType()
STRINGS, INTS, FLOATS = ArrayType(STRING), ArrayType(INT), ArrayType(FLOAT)


def struct(**fields: DataType) -> StructType:
    out = StructType()
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out
