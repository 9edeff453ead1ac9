"""Classes of this package that run in Spark's own process, compiled when they are first asked for.

Spark brings the compiler (Janino, for its generated code) and hands a jar that is added later
to the executors, so nothing has to be built or installed."""

import hashlib
import os
import pkgutil
import zipfile

from pyspark.sql import SparkSession

PACKAGE = "feedskein"


def native(spark: SparkSession, name: str):
    """A new object of the class PACKAGE.name, whose source is <name>.java beside this module."""
    source = pkgutil.get_data(__package__, f"{name}.java")
    jar = f"{PACKAGE}-{name}-{hashlib.sha256(source).hexdigest()[:16]}.jar"
    # the driver may know the class from a context before, whose executors are gone
    if jar not in spark.sparkContext._jsc.sc().listJars().mkString(" "):
        path = os.path.join(spark.sparkContext._temp_dir, jar)  # a folder that goes with the context
        _compile(spark, source.decode(), path)
        spark.sql(f"ADD JAR '{path}'")
    return spark._jsparkSession.sharedState().jarClassLoader().loadClass(f"{PACKAGE}.{name}").newInstance()


def _compile(spark, source, path):
    compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(spark._jsparkSession.sharedState().jarClassLoader())
    compiler.cook(source)
    with zipfile.ZipFile(path, "w") as jar:
        for name, code in compiler.getBytecodes().items():
            jar.writestr(f"{name.replace('.', '/')}.class", bytes(code))
