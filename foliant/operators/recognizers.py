"""What counts as personal data: a table of fixed values, without code."""

from __future__ import annotations

#: Entity, pattern, base score, words that raise it, redacted group, check, generic.
RECOGNIZERS = (
    ("AADHAAR_NUMBER", r"\b[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}\b", 0.3, ("aadhaar", "aadhar", "uidai", "uid", "unique identification"), 0, "verhoeff", False),
    ("PAN_NUMBER", r"\b[A-Z]{5}\d{4}[A-Z]\b", 0.6, ("pan", "permanent account number", "income tax"), 0, None, False),
    ("IN_PERSON_NAME", r"\b(?:Mrs|Mr|Ms|Dr|Shri|Smt|Prof)\.?\s+[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,2}\b", 0.5, ("name", "borrower", "applicant", "holder", "son", "daughter", "wife"), 0, None, False),
    ("IN_ADDRESS", r"\b(?:s/o|d/o|w/o|c/o)\.?\s+[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,2}\b", 0.5, ("address", "residing", "resides", "permanent", "present", "belongs", "property", "premises"), 0, None, False),
    ("IN_ADDRESS", r"\b(?:H|F|SF|FF)\.?\s*No\.?\s*[-\s]?\s*\d+[A-Za-z]?(?:\s*,\s*[^\n,.;]{2,30}){0,3}", 0.5, ("address", "residing", "resides", "permanent", "present", "belongs", "property", "premises"), 0, None, False),
    ("IN_ADDRESS", r"\b(?:streets?|roads?|lanes?|avenues?|colony|nagar|sector|villas?|towers?|apartments?|locality|estate|bhawan|society|layout|chawl|marg)\b[^\n,.]{0,30}", 0.5, ("address", "residing", "resides", "permanent", "present", "belongs", "property", "premises"), 0, None, False),
    ("IN_ADDRESS", r"(?:^|[:,]|\n)\s*[A-Za-z][A-Za-z.]{1,20}(?:\s+[A-Za-z][A-Za-z.]{1,20}){0,2}\s*[-–]\s*[1-9]\d{5}\b", 0.5, ("address", "residing", "resides", "permanent", "present", "belongs", "property", "premises"), 0, None, False),
    ("IN_PINCODE", r"\b[1-9]\d{5}\b", 0.35, ("pincode", "pin code", "pin", "postal", "zip", "district", "address", "village", "taluka", "post office"), 0, None, False),
    ("IN_ACCOUNT_NO", r"\ba\s*/?\s*c\.?\s*(?:no\.?|number|num\.?)?\s*(?:is|of)?\s*[:\-]?\s*(\d(?:[ \-]?\d){7,19})", 0.75, ("account", "a/c", "bank", "savings", "current", "beneficiary", "salary", "neft", "rtgs", "imps"), 1, None, False),
    ("IN_ACCOUNT_NO", r"\ba\s*/?\s*c\s+(?:acc(?:ount)?|acct)\.?\s*(?:no\.?|number|num\.?|#)\s*(?:is|of)?\s*[:\-]?\s*(\d(?:[ \-]?\d){7,19})", 0.75, ("account", "a/c", "bank", "savings", "current", "beneficiary", "salary", "neft", "rtgs", "imps"), 1, None, False),
    ("IN_ACCOUNT_NO", r"\b(?:acc(?:ount)?|acct)\.?\s*(?:no\.?|number|num\.?|#)\s*(?:is|of)?\s*[:\-]?\s*(\d(?:[ \-]?\d){7,19})", 0.75, ("account", "a/c", "bank", "savings", "current", "beneficiary", "salary", "neft", "rtgs", "imps"), 1, None, False),
    ("IN_ACCOUNT_NO", r"\b(?:savings?|current|beneficiary|primary|salary|joint)\s+(?:acc(?:ount)?|acct)\.?\s*(?:no\.?|number|num\.?|#)\s*(?:is|of)?\s*[:\-]?\s*(\d(?:[ \-]?\d){7,19})", 0.75, ("account", "a/c", "bank", "savings", "current", "beneficiary", "salary", "neft", "rtgs", "imps"), 1, None, False),
    ("IN_LOAN_NO", r"\bloan\s*(?:a\s*/?\s*c|(?:acc(?:ount)?|acct))\.?\s*(?:no\.?|number|num\.?|#)?\s*(?:is|of)?\s*[:\-]?\s*(\d(?:[ \-]?\d){7,19})", 0.8, ("loan", "loan account", "disbursal", "emi", "sanction", "instalment"), 1, None, False),
    ("IN_LOAN_NO", r"\bloan\s*(?:no\.?|number|num\.?|#)\s*(?:is|of)?\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/]{5,19})", 0.8, ("loan", "loan account", "disbursal", "emi", "sanction", "instalment"), 1, None, False),
    ("IN_LOAN_NO", r"\b(?:disbursal|sanction|emi)\s*(?:a\s*/?\s*c|(?:acc(?:ount)?|acct))\.?\s*(?:no\.?|number|num\.?|#)?\s*(?:is|of)?\s*[:\-]?\s*(\d(?:[ \-]?\d){7,19})", 0.8, ("loan", "loan account", "disbursal", "emi", "sanction", "instalment"), 1, None, False),
    ("IFSC_CODE", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.6, ("ifsc", "bank", "branch", "neft", "rtgs", "imps", "upi", "micr"), 0, None, False),
    ("MICR_CODE", r"\b[0-9]{6}\b", 0.35, ("micr", "branch code", "ifsc", "cheque clearing", "routing"), 0, None, False),
    ("GSTIN", r"\b\d{2}[A-Z]{5}\d{4}[A-Z]\dZ[A-Z\d]\b", 0.6, ("gstin", "gst", "goods and services", "tax"), 0, None, False),
    ("UPI_ID", r"\bupi\b\.?\s*(?:id|handle)?\.?\s*[:\-]?\s*([A-Za-z0-9._\-]{2,63}[A-Za-z0-9]@[A-Za-z0-9._\-]{2,63}[A-Za-z0-9])", 0.75, ("upi", "vpa", "pay", "transfer", "handle", "qr", "imps"), 1, None, False),
    ("UPI_ID", r"\bvpa\b\.?\s*(?:id|address)?\.?\s*[:\-]?\s*([A-Za-z0-9._\-]{2,63}[A-Za-z0-9]@[A-Za-z0-9._\-]{2,63}[A-Za-z0-9])", 0.75, (), 1, None, False),
    ("UPI_ID", r"\bpay\s*to\b\s*[:\-]?\s*([A-Za-z0-9._\-]{2,63}[A-Za-z0-9]@[A-Za-z0-9._\-]{2,63}[A-Za-z0-9])", 0.75, (), 1, None, False),
    ("CHEQUE_NO", r"\b(?:cheque|cheq|chq|demand\s+draft|draft)\.?\s*(?:no\.?|number|#)?\s*(?:is|dated)?\s*[:\-]?\s*(\d{6,8})\b", 0.7, (), 1, None, False),
    ("POLICY_NO", r"\b(?:policy|lic|licence|license|endowment|motor|insurance)\.?\s*(?:no\.?|number|num\.?|#)\s*(?:is|of)?\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/]{5,19})", 0.7, (), 1, None, False),
    ("VOTER_ID", r"\b(?:[A-Z]{3}\d{7}|[A-Z]\d{7}[A-Z])\b", 0.5, ("voter", "voter's", "epic", "electoral", "electroll", "booth"), 0, None, False),
    ("TAN_NUMBER", r"\b[A-Z]{4}\d{4}[A-Z]\d\b", 0.5, ("tan", "tax account"), 0, None, False),
    ("DL_NO", r"\b[A-Z]{2}[-\s]?\d{2}[-\s]?\d{4}[-\s]?\d{7}\b", 0.5, ("driving", "licence", "license", "dl", "permit", "rto"), 0, None, False),
    ("PASSPORT_NO", r"\b[A-Z]{1,2}[-\s]?\d{7}\b", 0.35, ("passport", "passport no"), 0, None, False),
    ("APPLICATION_ID", r"\b(?:application|applicant|customer|proposal|reference|ref|enquiry|lead|file)\.?\s*(?:no\.?|number|num\.?|#)\s*(?:is|of)?\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/]{5,19})", 0.7, (), 1, None, False),
    ("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 1.0, (), 0, None, False),
    ("CREDIT_CARD", r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{1,7}\b", 0.3, ("card", "credit", "debit", "visa", "mastercard"), 0, "luhn", True),
    ("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", 0.6, (), 0, None, False),
    ("US_SSN", r"\b\d{3}[- .]\d{2}[- .]\d{4}\b", 0.5, ("ssn", "social security"), 0, None, True),
    ("IBAN_CODE", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b", 0.3, ("iban",), 0, "iban", True),
    ("PHONE_NUMBER", r"(?<![\w.])(?:\+\d{1,3}[ -]?\d{3,5}[ -]?\d{3,6}|\(\d{2,4}\)[ -]?\d{3,4}[ -]?\d{3,4}|\d{3}[ -]\d{3}[ -]\d{4})\b", 0.4, ("phone", "mobile", "call", "tel", "contact"), 0, None, True),
    ("US_BANK_NUMBER", r"\b\d{8,17}\b", 0.05, ("check", "account", "acct", "bank", "debit"), 0, None, True),
)

#: Words before a name, and given names that begin one.
NAME_CUES = (
    "name", "named", "borrower", "applicant", "co-applicant", "holder", "guarantor", "nominee", "customer", "signed by", "contact person", "attention", "dear", "i am", "regards", "sincerely", "beneficiary",
)
GIVEN_NAMES = (
    "Aditya", "Ahmed", "Alan", "Alice", "Amit", "Amy", "Andrew", "Anil", "Anita", "Anna", "Anthony", "Arjun", "Arun", "Asha", "Barbara", "Ben", "Carlos", "Charles", "Chris", "Christopher", "Clara", "Daniel",
    "David", "Deepak", "Divya", "Edward", "Elena", "Elizabeth", "Emily", "Emma", "Fatima", "Frank", "Gaurav", "George", "Grace", "Hans", "Harish", "Helen", "Henry", "Ibrahim", "James", "Jane", "Jean", "Jennifer",
    "John", "Jose", "Joseph", "Juan", "Julia", "Karan", "Karen", "Kavita", "Kevin", "Kiran", "Laura", "Linda", "Lisa", "Lucas", "Manoj", "Maria", "Mark", "Mary", "Meera", "Michael", "Mohammed", "Neha", "Nikhil",
    "Olivia", "Patricia", "Paul", "Peter", "Pierre", "Pooja", "Prakash", "Priya", "Rahul", "Raj", "Rajesh", "Ramesh", "Ravi", "Rebecca", "Richard", "Robert", "Rohit", "Sandeep", "Sanjay", "Sara", "Sarah", "Sharon",
    "Sita", "Sofia", "Steven", "Sunil", "Sunita", "Suresh", "Susan", "Thomas", "Vijay", "Vikram", "Vivek", "William", "Yusuf",
)
