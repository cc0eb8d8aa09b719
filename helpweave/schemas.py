"""Schemas of the exchange formats."""

LINK = "struct<deeplink:string,description:string,message:string,classes:map<string,string>,originalType:string>"
CHECK = "struct<deeplink:string,key:string,resultType:string,condition:string,value:string>"
GROUP = f"struct<steps:array<string>,validationDeeplink:{CHECK},actionableDeeplink:{LINK}>"
ACTION = f"struct<actionName:string,description:string,stepGroups:array<{GROUP}>,category:string>"
GOAL = f"struct<goal:string,title:string,actions:array<{ACTION}>,score:double>"
RESPONSE = f"contexts array<{GOAL}>, _corrupt_record string"
CATALOG = f"deeplinks array<struct<id:string,deeplink:string,description:string,message:string,originalType:string,control_type:int,qna_description:string,validation:{CHECK}>>"
ARTICLES = "responses array<struct<id:string,original_query:string,siis_response:struct<title:string,content:string>>>"
MODEL_OUTPUT = (
    "goal string, title string, score double, topic string, variations array<string>, query_variations array<string>, "
    "actions array<struct<name:string,desc:string,cat:string,steps:array<string>,actionName:string,description:string,"
    f"category:string,stepGroups:array<{GROUP}>>>, _corrupt_record string"
)
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
