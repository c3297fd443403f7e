"""The unified document model as Spark types.

Order is carried by array position. The model has no recursive type: a table cell holds text blocks, and a container is
followed by the blocks inside it, whose `depth` is one more than its own (null is 0, the page's own blocks). Containers
of any size can also be rows of an adjacency table (see operators.render.render_containers).
"""

RECT = "struct<x:double,y:double,width:double,height:double>"
STYLE = "struct<font_family:string,font_size:double,bold:boolean,italic:boolean,underline:boolean,strikethrough:boolean,color:string,background_color:string>"
RUN = f"struct<text:string,style:{STYLE}>"
CELL = f"struct<content:array<array<{RUN}>>,col_span:int,row_span:int,background_color:string>"
PATH = "struct<commands:array<struct<op:string,points:array<double>>>,fill:string,stroke:string,stroke_width:double>"
BLOCK = (
    f"struct<kind:string,bounds:{RECT},rotation:double,runs:array<{RUN}>,paragraph_style:string,"
    f"fill_color:string,stroke_color:string,stroke_width:double,rows:array<array<{CELL}>>,"
    f"resource_id:string,alt_text:string,format:string,paths:array<{PATH}>,depth:int>"
)
PAGE = f"struct<number:int,width:double,height:double,label:string,rotation:int,blocks:array<{BLOCK}>>"
IMAGE = "struct<id:string,mime_type:string,data:binary,width:int,height:int>"
VALUE = "struct<s:string,i:bigint,f:double,b:boolean,t:timestamp>"
METADATA = f"struct<title:string,author:string,subject:string,keywords:array<string>,creator:string,producer:string,created:timestamp,modified:timestamp,language:string,custom:map<string,{VALUE}>>"
ATTACHMENT = "struct<filename:string,mime_type:string,description:string,data:binary>"
ERROR = "struct<kind:string,message:string>"
DOCUMENT = f"struct<metadata:{METADATA},pages:array<{PAGE}>,images:array<{IMAGE}>,attachments:array<{ATTACHMENT}>,error:{ERROR}>"

#: Page sizes in points (fixed values).
LETTER = (612.0, 792.0)
A4 = (595.28, 841.89)
WEB = (850.0, 1100.0)
