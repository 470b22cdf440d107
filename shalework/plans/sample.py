"""A small set of reports of our own with the catalogs that the ``reports`` table lacks: value lists, accounts, privileges, functions, data sources,
menus, hide rules, and references between files. The XML queries run over it as they do over the table, and are held against the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shalework.plans.reports import delivered
from shalework.session import cut
from shalework.sources import reports as R

HARBOUR = """<?xml version="1.0" encoding="UTF-16"?><FMPReport type="Report" version="22"><File name="Harbour.fmp12" path="fmnet:/quay/Harbour.fmp12">
<BaseTableCatalog><BaseTable id="11" name="Vessels" records="40"><FieldCatalog><Field id="1" name="vessel_key" dataType="Text" fieldType="Normal"><Comment> key of a vessel </Comment><AutoEnter value="SerialNumber"><Serial nextValue="41" increment="1" generate="OnCreation"/></AutoEnter><Validation><NotEmpty value="True"/><Unique value="True"/></Validation></Field>
<Field id="2" name="tonnage" dataType="Number" fieldType="Calculated"><Calculation>length * beam</Calculation></Field><Field id="3" name="=== hidden ===" dataType="Text" fieldType="Normal"/><Field id="4" name="g_today" dataType="Date" fieldType="Normal"><Storage global="True" maxRepetition="2"/></Field>
<Field id="5" name="sum_tonnage" dataType="Number" fieldType="Summary"/><Field id="6" name="may_sail" dataType="Number" fieldType="Normal"><Storage index="All"/></Field></FieldCatalog></BaseTable><BaseTable id="12" name="Berths"><Field id="1" name="berth_key" dataType="Text" fieldType="Normal"><AutoEnter><Calculation>Get ( UUID )</Calculation></AutoEnter></Field><Field id="2" name="vessel_key" dataType="Text" fieldType="Normal"/></BaseTable></BaseTableCatalog>
<RelationshipGraph><TableList><Table id="101" name="Vessels" baseTable="Vessels" baseTableId="11"/><Table id="102" name="Berths" baseTable="Berths" baseTableId="12"/><Table id="103" name="Cargo"><BaseTable id="21" name="Crates"/><FileReference id="7" name="Depot"/></Table><Table id="104" name="Lost" baseTable="Gone" baseTableId="9"><FileReference id="8" name="Nowhere"/></Table></TableList>
<RelationshipList><Relationship id="1"><LeftTable name="Vessels" cascadeCreate="True"/><RightTable name="Berths" cascadeDelete="True"/><JoinPredicateList><JoinPredicate type="Equal"><LeftField><Field table="Vessels" id="1" name="vessel_key"/></LeftField><RightField><Field table="Berths" id="2" name="vessel_key"/></RightField></JoinPredicate></JoinPredicateList></Relationship>
<Relationship id="2"><LeftTable name="Vessels"/><RightTable name="Cargo"/><LeftOptions deleteRelated="True" createRelated="False"/><JoinPredicateList><JoinPredicate><LeftField><Field table="Vessels" id="6" name="may_sail"/></LeftField><RightField><Field table="Cargo" id="1" name="crate_key"/></RightField></JoinPredicate><JoinPredicate type="LessThan"><LeftField><Field table="Vessels" id="2" name="tonnage"/></LeftField><RightField><Field table="Cargo" id="2" name="weight"/></RightField></JoinPredicate></JoinPredicateList></Relationship>
<Relationship id="3"><LeftTable name="Berths"/><RightTable name="Berths"/><JoinPredicateList><JoinPredicate type="CartesianProduct"><LeftField/><RightField/></JoinPredicate></JoinPredicateList></Relationship></RelationshipList></RelationshipGraph>
<LayoutCatalog><Layout id="31" name="Quay" width="800" includeInMenu="True"><Table id="101" name="Vessels"/><Object type="Field" key="1" name="sail"><FieldObj displayType="3"><Name>Vessels::may_sail</Name><DDRInfo><Field table="Vessels" id="6" name="may_sail"/></DDRInfo></FieldObj><HideCondition><Calculation>Get ( AccountName ) = "quayhand"</Calculation></HideCondition></Object>
<Object type="Field" key="2"><FieldObj><Name>Berths::berth_key</Name></FieldObj><HideCondition><Calculation>1</Calculation></HideCondition></Object><Object type="Field" key="3"><FieldObj><Name>Berths::berth_key</Name></FieldObj></Object><Object type="Portal" key="4"><PortalObj><TableAliasKey> Cargo </TableAliasKey><FieldList><Field table="Cargo" id="2" name="weight"/></FieldList></PortalObj></Object>
<Object type="Button" key="5" name="go"><ButtonObj buttonFlags="2"><Step id="1" name="Perform Script"><StepText>Perform Script [ “Weigh” ]</StepText><Script id="52" name="Weigh"/><FileReference id="7" name="Depot"/></Step></ButtonObj><ConditionalFormatting><Item id="0" flags="1"><Condition op="3"><Calculation>Vessels::tonnage &gt; 9</Calculation></Condition><Format><Styles><LocalCSS>color: rgba(1,2,3,0);</LocalCSS></Styles></Format></Item><Item id="1" flags="0"><Condition op="1"><Calculation>1</Calculation></Condition></Item></ConditionalFormatting></Object>
<Object type="Button" key="6"><ButtonObj><Step id="1" name="Perform Script"><Script id="41" name="Moor"/></Step></ButtonObj></Object></Layout><Group id="32" name="Forms"><Group id="33" name="Old"><Layout id="34" name="Manifest"><Table id="103" name="Cargo"/></Layout></Group><Layout id="35" name="-"/></Group></LayoutCatalog>
<ScriptCatalog><Script id="41" name="Moor" includeInMenu="True" runFullAccess="True"><StepList><Step id="68" name="If" enable="True"><StepText>If [ Vessels::may_sail ]</StepText><Calculation>Vessels::may_sail</Calculation><DisplayCalculation><Chunk type="FieldRef"><Field table="Vessels" id="6" name="may_sail"/></Chunk><Chunk type="NoRef"> and </Chunk><Chunk type="CustomFunctionRef">Knots</Chunk><Chunk type="FunctionRef">Get</Chunk></DisplayCalculation></Step><Step id="76" name="Set Field" enable="True"><StepText>Set Field [ Berths::vessel_key ; 1 ]</StepText><Field table="Berths" id="2" name="vessel_key"/><Calculation>1</Calculation></Step><Step id="70" name="End If"><StepText>End If</StepText></Step><Step id="6" name="Go to Layout" enable="False"><StepText>// Go to Layout [ “Quay” ]</StepText><Layout id="31" name="Quay"/></Step><Step id="103" name="Exit Script"><StepText>Exit Script [ ]</StepText></Step><Step id="63" name="Send Mail"><StepText>Send Mail [ ]</StepText></Step></StepList></Script>
<Group id="42" name="Jobs"><Script id="43" name="Nightly count"><StepList><Step id="1" name="Perform Script" enable="True"><StepText>Perform Script [ “Moor” ]</StepText><Script id="41" name="Moor"/></Step><Step id="1" name="Perform Script" enable="True"><Script id="99" name="Sunk"/></Step><Step id="6" name="Go to Layout"><Layout id="34" name="Manifest"/></Step><Step id="1" name="Perform Script"><Script id="5" name="Elsewhere"/><FileReference id="8" name="Nowhere"/></Step><Step id="142" name="Install Menu Set"><CustomMenuSet id="92" name="Deck"/></Step></StepList></Script></Group><Script id="44" name="-"/></ScriptCatalog>
<ValueListCatalog><ValueList id="61" name="Flags"><Source value="Custom"/><CustomValues><Text> red
 green

</Text></CustomValues></ValueList><ValueList id="62" name="Crates"><Source value="Field"/><PrimaryField show="True"><Field table="Cargo" id="1" name="crate_key"/></PrimaryField><ShowRelated value="True"><Table name="Vessels"/></ShowRelated></ValueList><ValueList id="63" name="Far"><Source value="External"/><External><FileReference id="7" name="Depot"><UniversalPathList>file:Depot</UniversalPathList></FileReference><ValueList id="64" name="Near"/></External></ValueList><ValueList id="65" name="Puzzle"><Source value="Riddle"><Inner/></Source><Rest/></ValueList></ValueListCatalog>
<AccountCatalog><Account id="71" name="quayhand" status="Active" privilegeSet="Crew" emptyPassword="True"/><Account id="72" name="[Guest]" status="Inactive" privilegeSet="[Read]" emptyPassword="False"/></AccountCatalog>
<PrivilegesCatalog><PrivilegeSet id="73" name="Crew" menu="Minimal" printing="False"><Records value="Custom"><TableList><BaseTable id="11" name="Vessels"><Create value="True"/><View value="Limited"><Calculation>Vessels::may_sail</Calculation></View><Edit value="False"/><Delete value="False"/><FieldAccess value="Limited"><FieldList><Field id="5" name="sum_tonnage" accessRestriction="NoAccess"/></FieldList></FieldAccess></BaseTable><BaseTable id="12" name="Berths"><Create value="True"/><View value="True"/><Edit value="True"/><Delete value="True"/></BaseTable></TableList></Records><Layouts value="Custom" allowCreation="False"><LayoutList><Layout id="31" name="Quay"><LayoutAccess value="ViewOnly"/><DataAccess value="Modifiable"/></Layout></LayoutList></Layouts></PrivilegeSet></PrivilegesCatalog>
<ExtendedPrivilegeCatalog><ExtendedPrivilege id="81" name="fmrest"/><ExtendedPrivilege id="82" name="fmreauthenticate10"/><ExtendedPrivilege id="83" name="tide"/></ExtendedPrivilegeCatalog>
<CustomFunctionCatalog><CustomFunction id="84" name="Knots" parameters="miles ; get"><Calculation>If ( miles &gt; 1 ; Reef ( miles - 1 ) ; 0 )</Calculation><DisplayCalculation><Chunk type="CustomFunctionRef">Reef</Chunk></DisplayCalculation></CustomFunction><CustomFunction id="85" name="Reef" parameters="n"><Calculation>Knots ( n )</Calculation><DisplayCalculation><Chunk type="CustomFunctionRef">Knots</Chunk></DisplayCalculation></CustomFunction><CustomFunction id="86" name="Miles" parameters="" visible="False"><Calculation>1</Calculation></CustomFunction></CustomFunctionCatalog>
<ExternalDataSourcesCatalog><FileReference id="7" name="Depot" link="1" pathList="fmnet:/*/Elsewhere file:Depot"/><FileReference id="8" name="Nowhere" pathList="file:Nowhere"/><OdbcDataSource id="9" name="Tides" DSN="tide_dsn"/></ExternalDataSourcesCatalog>
<CustomMenuSetCatalog><CustomMenuSet id="92" name="Deck"/></CustomMenuSetCatalog><CustomMenuCatalog><CustomMenu id="91" name="Sails"><MenuItemList><CommandMenuItem name="Open" enabled="False"/><ActionMenuItem name="Hoist"><Step id="1" name="Perform Script"><Script id="43" name="Nightly count"/></Step></ActionMenuItem></MenuItemList></CustomMenu></CustomMenuCatalog></File></FMPReport>"""

DEPOT = """<FMPReport type="Report" version="21"><File name="Depot.fmp12"><BaseTableCatalog><BaseTable id="21" name="Crates" records="7"><FieldCatalog><Field id="1" name="crate_key" dataType="Text" fieldType="Normal"><Validation><Unique value="True"/></Validation></Field><Field id="2" name="weight" dataType="Number" fieldType="Normal"/></FieldCatalog></BaseTable></BaseTableCatalog>
<RelationshipGraph><TableList><Table id="201" name="Crates" baseTable="Crates" baseTableId="21"/></TableList><RelationshipList/></RelationshipGraph><ScriptCatalog><Script id="51" name="Lift"><StepList><Step id="1" name="Perform Script"><StepText>Perform Script [ “Weigh” ]</StepText><Script id="52" name="Weigh"/></Step></StepList></Script><Script id="52" name="Weigh" includeInMenu="False"><StepList/></Script></ScriptCatalog>
<CustomFunctionCatalog><CustomFunction id="1" name="Single" parameters="x"><Calculation>1</Calculation></CustomFunction></CustomFunctionCatalog><PrivilegesCatalog><PrivilegeSet id="5" name="Crew" menu="All"><Records value="All"/></PrivilegeSet></PrivilegesCatalog></File></FMPReport>"""

#: An earlier report of a file that came again, a document that is none, and one that cannot be read.
DOCUMENTS = (("1", DEPOT.replace('name="weight"', 'name="mass"')), ("2", HARBOUR), ("3", DEPOT), ("4", '<FMPReport type="Summary"/>'), ("5", "<FMPReport type='Report'><File>"))

#: The same documents as SQL.
SQL = "SELECT doc, body, NULL::TIMESTAMP AS received_at, CAST(doc AS BIGINT) AS ord FROM (VALUES " + ", ".join(f"('{d}', '{b.replace(chr(39), chr(39) * 2)}')" for d, b in DOCUMENTS) + ") v(doc, body)"

_cut: dict[str, DataFrame] = {}


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DOCUMENTS), "doc string, text string")


def nodes(spark: SparkSession) -> DataFrame:
    app = spark.sparkContext.applicationId
    if app not in _cut:
        _cut[app] = cut(delivered(R.shred(documents(spark))))
    return _cut[app]
