"""Query trees and their compilation to Columns."""
