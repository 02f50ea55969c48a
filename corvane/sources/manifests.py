"""Numbered manifests in a folder: the last one is what readers follow.

A manifest appears whole or not at all, and each number is taken once: on HDFS and the like by a rename
that refuses an existing target, on a local or mounted folder by a hard link, which fails if the name is
there. Object stores give neither; a folder on one of them is refused.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession

#: Schemes whose rename isn't atomic.
OBJECT_STORES = ("s3", "s3a", "s3n", "gs", "wasb", "wasbs")


class Manifests:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, os.path.join(folder, "manifests")

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def fs(self, name: str):
        return self.path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        fs, p = self.fs(self.folder), self.path(self.folder)
        if not fs.exists(p):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in found if n.endswith(".json") and not n.startswith("_"))

    def last(self) -> dict | None:
        names = self.names()
        if not names:
            return None
        return json.loads(self.spark.read.text(os.path.join(self.folder, names[-1]), wholetext=True).head()[0])

    def publish(self, version: int, content: dict) -> bool:
        """Make ``content`` the manifest of that number. False, without a change, if the number is taken."""
        fs = self.fs(self.folder)
        scheme = fs.getUri().getScheme()
        if scheme in OBJECT_STORES:
            raise ValueError(f"manifests need a file system with atomic rename, not {scheme}")
        draft = self.path(os.path.join(self.folder, f"_{uuid.uuid4().hex}"))
        target = self.path(os.path.join(self.folder, f"{version:012d}.json"))
        fs.mkdirs(target.getParent())
        stream = fs.create(draft)
        stream.write(json.dumps(content).encode())
        stream.close()
        try:
            if scheme == "file":
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            else:
                jvm = self.spark._jvm
                none = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(target), none)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        finally:
            if fs.exists(draft):
                fs.delete(draft, False)
