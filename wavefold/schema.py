"""Schemas of the field and of the six catalogue tables; empty tables keep their columns."""

from __future__ import annotations

FIELD = "time int, lat_idx int, lon_idx int, lat double, lon double, v double"
TABLES = {
    "nodes": "time bigint, rwp_id bigint, node_id bigint, node_type string, lon double, lat double, scalar double, cluster_id bigint, region_id bigint",
    "edges": "time bigint, rwp_id bigint, src_node_id bigint, dst_node_id bigint",
    "rwps": "time bigint, rwp_id bigint, weighted_lon double, weighted_lat double, peak_amp double, n_nodes bigint, zonal_extent_deg double, geometry_wkb binary",
    "samples": "time bigint, rwp_id bigint, pt_idx bigint, lon double, lat double",
    "track_nodes": "time bigint, feature bigint, lon double, lat double, key string",
    "track_edges": "src string, dst string, time_from bigint, feat_from bigint, time_to bigint, feat_to bigint, weight double, distance double",
}
