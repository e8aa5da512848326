"""Schemas of the data model."""

from __future__ import annotations

RASTER = "raster_id long, h int, w int, data array<double>"
POSITIONS = "array<struct<x:int,y:int>>"
BOX = "struct<xmin:int,ymin:int,xmax:int,ymax:int>"
HEADER = "map<string,string>"
HDU = "struct<idx:int,header:map<string,string>,bitpix:int,naxis:array<int>,data:array<double>>"
SEGMENTATION = "struct<rle:struct<size:array<int>,counts:string>,polygons:array<array<int>>>"
TRAINING_METADATA = (
    "struct<RA:double,DEC:double,grg_positions:array<array<int>>,all_component_positions:array<array<int>>,rotated:boolean,origin_id:bigint,"
    "rotation_angle:double,stretch:string,reprojected:boolean,old_redshift:double,new_redshift:double>"
)
SEARCH_METADATA = "struct<RA:double,DEC:double,positions:map<string,struct<x:int,y:int>>,stretch:string>"
COCO_IMAGE = f"struct<id:bigint,file_name:string,width:int,height:int,metadata:{TRAINING_METADATA}>"
COCO_ANNOTATION = f"struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,segmentation:{SEGMENTATION},iscrowd:int>"
COCO_CATEGORY = "struct<id:bigint,name:string>"
