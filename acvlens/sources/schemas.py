"""Declared schemas of the three inputs (no schema inference: it costs a pass)."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
# Sums and derived money totals: wide enough for any realistic total.
MONEY_SUM = T.DecimalType(38, 2)

OPPORTUNITY = T.StructType([
    T.StructField("Id", T.StringType(), False),
    T.StructField("AccountId", T.StringType(), True),
    T.StructField("StageName", T.StringType(), True),
    T.StructField("CloseDate", T.DateType(), True),
    T.StructField("ACV_for_Quotas__c", MONEY, True),
    T.StructField("TCV_Gross__c", MONEY, True),
    T.StructField("Record_Type_Name__c", T.StringType(), True),
    T.StructField("Referring_CPA__c", T.StringType(), True),
    T.StructField("Referral_1_Account__c", T.StringType(), True),
    T.StructField("Referral_2_Account__c", T.StringType(), True),
    T.StructField("CPA_Contact_Account__c", T.StringType(), True),
    T.StructField("shov_revenue_type__c", T.StringType(), True),
    T.StructField("OwnerId", T.StringType(), True),
])

ACCOUNT = T.StructType([
    T.StructField("Id", T.StringType(), False),
    T.StructField("Name", T.StringType(), True),
    T.StructField("Client_Type__c", T.StringType(), True),
])

OPP_REPORT = T.StructType([
    T.StructField("Opp_ID", T.StringType(), True),
    T.StructField("Acct_Id", T.StringType(), True),
    T.StructField("CPA_Contact_Acct_ID", T.StringType(), True),
    T.StructField("Record_Type_Name", T.StringType(), True),
    T.StructField("Close_Date", T.StringType(), True),
    T.StructField("ACV_for_Quotas", MONEY, True),
    T.StructField("Stage", T.StringType(), True),
])

# Columns of the opportunity "accessory fields" pull that the referral
# edges are joined with.
OPP_FIELDS = (
    "Id", "ACV_for_Quotas__c", "Record_Type_Name__c", "StageName",
    "shov_revenue_type__c", "CloseDate", "TCV_Gross__c", "OwnerId",
)
# Columns of the "all opportunities" pull used by the win-rate tables.
ALL_OPP_FIELDS = (
    "Id", "ACV_for_Quotas__c", "Record_Type_Name__c", "StageName",
    "shov_revenue_type__c", "CloseDate", "TCV_Gross__c",
    "CPA_Contact_Account__c", "Referring_CPA__c", "Referral_1_Account__c",
    "Referral_2_Account__c",
)
