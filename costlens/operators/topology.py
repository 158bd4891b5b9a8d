"""Ownership graph joins.

The reference walks cluster -> nodegroup -> scaling group -> instance with one
API call per edge; here each edge is a table and the walk is equi-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_instances(nodegroups: DataFrame, asg_members: DataFrame) -> DataFrame:
    """TOP-1: (cluster, nodegroup, asgs[]) ⨝ scaling-group members using the
    first scaling group of each nodegroup -> (cluster, nodegroup, asg, instance_id);
    a nodegroup without scaling groups has no instances.

    `asg_members` is either the flat edge table (asg, instance_id) — the form
    to export at scale — or the API shape (asg, instance_ids[])."""
    ng = nodegroups.select("cluster", "nodegroup", F.get("asgs", F.lit(0)).alias("asg"))
    if "instance_ids" in asg_members.columns:
        mem = asg_members.select("asg", F.explode("instance_ids").alias("instance_id"))
    else:
        mem = asg_members.select("asg", "instance_id")
    return ng.join(mem, "asg").select("cluster", "nodegroup", "asg", "instance_id")


def instance_volumes(instance_devices: DataFrame) -> DataFrame:
    """TOP-2: instance -> attached volume ids."""
    return instance_devices.select(
        "instance_id", F.explode("block_devices").alias("bd")
    ).select("instance_id", F.col("bd.ebs.volume_id").alias("volume_id"))


def flatten_instances(reservations: DataFrame) -> DataFrame:
    """TOP-3: reservations[].instances[] -> one row per instance."""
    return reservations.select("reservation_id", F.explode("instances").alias("i")).select(
        "reservation_id", "i.*"
    )
