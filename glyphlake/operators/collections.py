"""Users and their images (U1-U10, R8) as tables; changes return new tables and a status per request.

users (email, user_id), images (email, image_id, path). A collection remembers the highest id it ever gave out, so that ids
are not used again after a deletion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a request reports.
ADDED, EXISTS, DELETED, UNKNOWN, REMOVED = "added", "already exists", "deleted", "unknown user", "removed"
NO_USER, DUPLICATE = -1, -2


def user_id(email: Column) -> Column:
    """The id of an email: a 64-bit hash."""
    return F.xxhash64(email)


def email_of(number: Column) -> Column:
    """The email that stands for a numeric user."""
    return F.concat(number.cast("string"), F.lit("@example.com"))


def add_users(users: DataFrame, emails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users with the new emails, and (email, status). Repeated and known emails are not added again."""
    asked = emails.select("email").where("email is not null").distinct()
    known = users.select("email").withColumn("_known", F.lit(True))
    status = asked.join(known, "email", "left").select("email", F.when(F.col("_known"), EXISTS).otherwise(ADDED).alias("status"))
    fresh = status.where(F.col("status") == ADDED).select("email", user_id(F.col("email")).alias("user_id"))
    return users.select("email", "user_id").unionByName(fresh), status


def colliding(users: DataFrame) -> DataFrame:
    """Ids that several emails share; callers refuse an addition that makes this non-empty."""
    return users.groupBy("user_id").agg(F.count_distinct("email").alias("emails")).where("emails > 1")


def find_users(users: DataFrame, keys: DataFrame) -> DataFrame:
    """Users whose email or id is asked for: keys (email, user_id), either may be null."""
    by_email = users.join(keys.select("email").where("email is not null"), "email", "left_semi")
    by_id = users.join(keys.select("user_id").where("user_id is not null"), "user_id", "left_semi")
    return by_email.unionByName(by_id).distinct()


def delete_users(users: DataFrame, emails: DataFrame, images: DataFrame | None = None, purge: bool = False):
    """U4: users without the given emails, and (email, status); with purge also the images that are left.

    Without purge a deleted user's images stay, and are there again when the user is added anew.
    """
    asked = emails.select("email").where("email is not null").distinct()
    status = asked.join(users.select("email", F.lit(True).alias("_known")), "email", "left").select("email", F.when(F.col("_known"), DELETED).otherwise(UNKNOWN).alias("status"))
    left = users.join(asked, "email", "left_anti")
    if images is None:
        return left, status
    return left, status, images.join(asked, "email", "left_anti") if purge else images


def locations(users: DataFrame, emails: DataFrame, base: str = "users") -> DataFrame:
    """(email, location) of each asked email, the empty string for unknown ones."""
    known = users.select("email", F.concat(F.lit(f"{base}/user_"), "email").alias("_at"))
    return emails.select("email").distinct().join(known, "email", "left").select("email", F.coalesce("_at", F.lit("")).alias("location"))


def add_images(users: DataFrame, images: DataFrame, requests: DataFrame, high: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Images with the requested ones (email, path), and (email, path, image_id).

    image_id is NO_USER for unknown users and DUPLICATE for paths that the user has already; others get ids after the
    user's highest so far (``high``: (email, image_id), kept across deletions), in path order.
    """
    asked = requests.select("email", "path").distinct().join(users.select("email", F.lit(True).alias("_user")), "email", "left")
    asked = asked.join(images.select("email", "path", F.lit(True).alias("_has")), ["email", "path"], "left")
    marks = images.select("email", "image_id")
    marks = (marks if high is None else marks.unionByName(high.select("email", "image_id"))).groupBy("email").agg(F.max("image_id").alias("_max"))
    fresh = F.col("_user").isNotNull() & F.col("_has").isNull()
    order = Window.partitionBy("email", fresh).orderBy("path")
    given = F.coalesce("_max", F.lit(-1)) + F.row_number().over(order)
    status = asked.join(marks, "email", "left").select("email", "path", F.when(F.col("_user").isNull(), F.lit(NO_USER)).when(F.col("_has").isNotNull(), F.lit(DUPLICATE)).otherwise(given).cast("long").alias("image_id"))
    return images.select("email", "path", "image_id").unionByName(status.where("image_id >= 0")), status


def remove_images(images: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images without the requested (email, image_id), and (email, image_id, removed boolean); unknown ones change nothing."""
    asked = requests.select("email", "image_id").distinct()
    status = asked.join(images.select("email", "image_id", F.lit(True).alias("_has")), ["email", "image_id"], "left").select("email", "image_id", F.col("_has").isNotNull().alias("removed"))
    return images.join(asked, ["email", "image_id"], "left_anti"), status


def lookup(images: DataFrame, keys: DataFrame) -> DataFrame:
    """Images of the asked (email, image_id)."""
    return images.join(keys.select("email", "image_id").distinct(), ["email", "image_id"], "left_semi")


def counts(images: DataFrame) -> DataFrame:
    """(email, images)."""
    return images.groupBy("email").agg(F.count("*").alias("images"))


def retrieve(ranked: DataFrame, images: DataFrame, topn: int | None = None) -> DataFrame:
    """(query_id, names): file names of verified results in order, -1 where there is none.

    ranked: (query_id, image_id, rank, mark). Without topn all verified results of the first ten count, with it the first
    topn whether verified or not.
    """
    from glyphlake.functions.scalars import file_name, result_csv

    keep = F.col("mark") > 0 if topn is None else F.col("rank") <= topn
    named = ranked.join(images.select("image_id", file_name(F.col("path")).alias("name")), "image_id")
    rows = F.array_sort(F.collect_list(F.when(keep, F.struct("rank", "name"))))
    return named.groupBy("query_id").agg(result_csv(F.transform(rows, lambda r: r["name"])).alias("names"))
