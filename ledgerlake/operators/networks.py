"""Devices that share a network, in space linear in the memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.scalars import network_of


def memberships(addresses: DataFrame, device: str, address: str, mask: str) -> DataFrame:
    """(network, device): the distinct networks of each device's addresses; input that is no address of a network gives none."""
    rows = addresses.select(network_of(F.col(address), F.col(mask)).alias("network"), F.col(device).alias("device"))
    return rows.filter("network IS NOT NULL AND device IS NOT NULL").distinct()


def star_edges(members: DataFrame) -> DataFrame:
    """(network, hub, device): each member of memberships() but the hub, linked to the hub, the least device of its network.

    Two devices are neighbours exactly if they have a network in common, so a star for each network tells as much as all of its pairs, and what is connected
    stays connected. A network of any size is aggregated where its members are and never gathered.
    """
    hubs = members.groupBy("network").agg(F.min("device").alias("hub"))
    return members.join(hubs, "network").filter("device > hub").select("network", "hub", "device")
